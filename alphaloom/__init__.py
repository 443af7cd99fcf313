"""alphaloom: image matting and its dataflow operators on Spark DataFrames."""
