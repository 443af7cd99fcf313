"""Records of solvers and benchmarks as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_results(records: DataFrame, path: str) -> None:
    """A file of one JSON record a line for each partition."""
    records.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """multi_line reads files that hold one JSON list of records. Without a schema the files are read once more to find it."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema is not None else reader).json(path)
