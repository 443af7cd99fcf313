"""Matting of images as they arrive: a stateless stream of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alphaloom.plans import estimators
from alphaloom.sources import png
from alphaloom.sources.images import decoded, to_bytes

FILES = "path string, modificationTime timestamp, length long, content binary"


def cutouts(files: DataFrame, alpha: str | Callable = "cf", **options) -> DataFrame:
    """path and content, an RGBA PNG, of files whose fourth channel is the trimap. Works on batches and streams alike, a file at a time."""
    f = estimators.ALPHA[alpha] if isinstance(alpha, str) else alpha

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                a = decoded(content)
                if a.ndim != 3 or a.shape[2] != 4:
                    raise ValueError(f"{path} has no trimap as its fourth channel")
                matte = f(a[..., :3], a[..., 3], **options)
                fg = estimators.estimate_foreground_ml(a[..., :3], matte)
                yield pd.DataFrame({"path": [path], "content": [png.encode(to_bytes(np.concatenate((fg, matte[..., None]), axis=2)))]})

    return files.select("path", "content").mapInPandas(run, "path string, content binary")


def stream(spark: SparkSession, source: str, sink: str, checkpoint: str, alpha: str | Callable = "cf", **options) -> StreamingQuery:
    """Starts a query that matts each new file under source once and appends to the Parquet table sink."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(source).withColumn("path", F.col("path"))
    return cutouts(files, alpha, **options).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
