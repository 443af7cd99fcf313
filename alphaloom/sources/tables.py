"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where they go on a single machine whose session names no shared folder, as in tests.
LOCAL = "/tmp/checkpoints/alphaloom"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the folder of setCheckpointDir(), else on a single machine a local one. RuntimeError on a cluster that names none."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        own = context._jsc.sc().getCheckpointDir()
        named = own.get() if own.isDefined() else None
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = LOCAL
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and later reads survive the loss of any executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
