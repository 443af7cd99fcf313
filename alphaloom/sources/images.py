"""Images on disk to pixels and back."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from alphaloom.operators.neighbours import axis_weights
from alphaloom.sources import png

PIXELS = "path string, image_id long, y int, x int, r double, g double, b double, a double, v double"


def resized(a: np.ndarray, size: float | tuple[int, int] | None, resample: str = "box") -> np.ndarray:
    """size: a factor, or (width, height); cut off to whole pixels."""
    if size is None:
        return a
    h, w = a.shape[:2]
    w2, h2 = (int(w * size), int(h * size)) if np.isscalar(size) else size
    if resample in ("nearest", "none"):
        return a[np.minimum(np.arange(h2) * h // h2, h - 1)][:, np.minimum(np.arange(w2) * w // w2, w - 1)]
    out = a.astype(np.float64)
    for axis, n, m in ((0, h, h2), (1, w, w2)):
        k = np.zeros((m, n))
        for s, t, v in axis_weights(n, m, resample):
            k[t, s] = v
        out = np.moveaxis(np.tensordot(k, out, (1, axis)), 0, axis)
    return out


def decoded(content: bytes, mode: str | None = None, size=None, resample: str = "box") -> np.ndarray:
    """Values in [0, 1]: over 255 whatever the depth. mode: GRAY or RGB converts; None keeps the channels."""
    a = png.decode(content)
    if mode == "GRAY" and a.ndim == 3:
        a = a[..., 0] if a.shape[2] == 2 else (a[..., :3].astype(np.uint32) @ np.array([19595, 38470, 7471], np.uint32) + 0x8000) >> 16
    elif mode == "RGB":
        a = np.repeat(a[..., None] if a.ndim == 2 else a[..., :1], 3, axis=2) if a.ndim == 2 or a.shape[2] == 2 else a[..., :3]
    elif mode not in (None, "GRAY"):
        raise ValueError(f"unknown mode {mode}")
    return resized(a, size, resample) / 255.0


def load_images(spark: SparkSession, path: str | Sequence[str], mode: str | None = None, size=None, resample: str = "box") -> DataFrame:
    """A row per pixel of PNG files; image_id is a hash of the path, v is set for gray images and r, g, b, a for others. Files are read by Spark and decoded where they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, i, content in zip(batch["path"], batch["image_id"], batch["content"], strict=True):
                a = decoded(content, mode, size, resample)
                y, x = (v.ravel().astype(np.int32) for v in np.mgrid[: a.shape[0], : a.shape[1]])
                flat = a.reshape(len(y), -1)
                names = {1: ["v"], 2: ["v", "a"], 3: ["r", "g", "b"], 4: ["r", "g", "b", "a"]}[flat.shape[1]]
                columns = {c: flat[:, names.index(c)] if c in names else np.full(len(y), np.nan) for c in ("r", "g", "b", "a", "v")}
                yield pd.DataFrame({"path": p, "image_id": i, "y": y, "x": x} | columns)

    files = spark.read.format("binaryFile").load(path).select("path", F.xxhash64("path").alias("image_id"), "content")
    out = files.mapInPandas(run, PIXELS)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("r", "g", "b", "a", "v")})


def from_image_source(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Pixels by Spark's own image source, whose bytes are blue, green, red."""
    raw = spark.read.format("image").load(path).select("image.*")
    at = lambda k: (F.conv(F.hex(F.substring("data", F.col("pos") * F.col("nChannels") + k + 1, F.lit(1))), 16, 10).cast("int") / 255.0)
    rows = raw.select(F.col("origin").alias("path"), F.xxhash64("origin").alias("image_id"), "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("pos"))
    three = F.col("nChannels") >= 3
    return rows.select("path", "image_id", F.expr("CAST(pos DIV width AS INT)").alias("y"), (F.col("pos") % F.col("width")).alias("x"), *(F.when(three, at(2 - k)).otherwise(at(0)).alias(c) for k, c in enumerate("rgb")))


def to_bytes(a: np.ndarray) -> np.ndarray:
    """Clipped and cut off, not rounded."""
    return a if a.dtype == np.uint8 else np.clip(a * 255, 0, 255).astype(np.uint8)


def encoded(images: DataFrame, columns: Sequence[str]) -> DataFrame:
    """image_id and content, a PNG file, of images of one, three or four columns in [0, 1]; each image is a group."""
    from alphaloom.plans.images import as_array

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "content": [png.encode(to_bytes(as_array(pdf, list(columns))))]})

    return images.select("image_id", "y", "x", *columns).groupBy("image_id").applyInPandas(run, "image_id long, content binary")


class PngWriter(DataSourceWriter):
    """Writes image_id.png for each row into a folder that driver and executors share."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        for row in rows:
            target = Path(self.folder, f"{row['image_id']}.png")
            part = target.with_name(f".{target.name}.{os.getpid()}")
            part.write_bytes(bytes(row["content"]))
            part.replace(target)  # whole or not at all, also when a task runs twice
        return WriterCommitMessage()


class PngSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "png_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PngWriter(self.options["path"])


def save_images(images: DataFrame, columns: Sequence[str], folder: str) -> None:
    images.sparkSession.dataSource.register(PngSink)
    encoded(images, columns).write.format("png_files").mode("append").save(folder)


def save_image(path: str, a: np.ndarray, make_directory: bool = True) -> None:
    if a.dtype not in (np.uint8, np.float32, np.float64):
        raise ValueError(f"images are uint8 or floating-point, not {a.dtype}")
    if make_directory:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(png.encode(to_bytes(a)))


def load_image(path: str, mode: str | None = None, size=None, resample: str = "box") -> np.ndarray:
    return decoded(Path(path).read_bytes(), mode, size, resample)
