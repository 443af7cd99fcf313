"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go on a single machine whose session names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/alphaloom"
#: The session's bound on the bytes of an Arrow batch, and the bound while written() runs: by rows alone a batch of long texts has no bound.
BATCH_BYTES, MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, else the one of setCheckpointDir(), else on a single machine a local one. RuntimeError on a cluster that names none."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        own = context._jsc.sc().getCheckpointDir()
        named = own.get() if own.isDefined() else None
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = LOCAL_CHECKPOINTS
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and later reads survive the loss of any executor. removed() deletes it. Python workers get their rows
    in batches of about MOST_BYTES, whatever the session says, which JVM and worker both hold."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(MOST_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_BYTES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that nothing will read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_parts(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes, which bounds what a worker holds besides a batch. At the end, what Arrow's pool keeps unused goes back to the system:
    workers outlive their tasks."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(most, batch.nbytes))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    pa.default_memory_pool().release_unused()


def id_text(column: Column) -> Column:
    """An id as text; null as empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(id_text(doc_id)) % parts


def sample_rate(doc_id: Column, rate: Column | float, salt: str) -> Column:
    """True for a share of ids that only the id and the salt decide."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|"), id_text(doc_id))), 1, 8), 16, 10).cast("double")
    return bits < F.lit(2.0**32) * (rate if isinstance(rate, Column) else F.lit(float(rate)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once: an expression is evaluated wherever it stands, a lambda's variable once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefixes(values: Column, zero: Column, merge: Callable[[Column, Column], Column], levels: int = 1, block: int = 128) -> Column:
    """Of an array of zero's type, for each place the merge of all values before it (zero at the first). Time and memory grow with the length, not with its square: places are
    merged within blocks, and blocks of blocks, of the given length."""

    def naive(xs: Column) -> Column:
        return F.transform(xs, lambda _, i: F.aggregate(F.slice(xs, F.lit(1), i), zero, merge))

    def blocked(xs: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, F.lit(block)))

        def with_blocks(blocks: Column) -> Column:
            whole = F.transform(blocks, lambda x: F.aggregate(x, zero, merge))
            up = prefixes(whole, zero, merge, levels - 1, block)
            return bound(up, lambda u: F.flatten(F.zip_with(blocks, u, lambda x, before: F.transform(naive(x), lambda v: merge(before, v)))))

        return F.when(F.size(xs) <= block, naive(xs)).otherwise(bound(cut, with_blocks))

    return bound(values, blocked if levels else naive)
