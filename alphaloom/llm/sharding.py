"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards. At each level a row draws one exponential variate per child from a hash of its key and the child's name,
with the child's weight (the sum of its shards') as rate, and goes to the child with the smallest draw. A draw depends on its own child alone, so if
a weight changes, rows move only into or out of the subtree whose weight changed. A new shard that is a subtree of its own thus takes rows only into
itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from alphaloom.llm.common import id_text, table

#: Sub-buckets of a shard, in which its slots are numbered: a shard is never sorted in one task.
BUCKETS_HEX = 3


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def balanced_tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2) -> list[Leaf]:
    per_region = racks_per_region * shards_per_rack
    return [Leaf(s // per_region, s // shards_per_rack % racks_per_region, s) for s in range(shards)]


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """With one more shard, as a region of its own: rows move into it and nowhere else."""
    return [*tree, Leaf(max((x.region for x in tree), default=-1) + 1, 0, max((x.shard for x in tree), default=-1) + 1, weight)]


def levels(tree: Sequence[Leaf]) -> tuple[list, list, list]:
    """The children of the root, of each region and of each rack, as (name, id, weight)."""
    regions: dict[int, dict[int, list[Leaf]]] = {}
    for x in tree:
        regions.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    weight = lambda xs: float(sum(x.weight for x in xs))
    top, middle, bottom = [], [], []
    for r, racks in sorted(regions.items()):
        top.append((f"r{r}", len(middle), weight(x for xs in racks.values() for x in xs)))
        middle.append([])
        for k, xs in sorted(racks.items()):
            middle[-1].append((f"r{r}k{k}", len(bottom), weight(xs)))
            bottom.append([(f"s{x.shard}", x.shard, float(x.weight)) for x in sorted(xs, key=lambda x: x.shard)])
    return top, middle, bottom


_CHILD = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("id", T.IntegerType(), False), T.StructField("weight", T.DoubleType(), False)])


def _literal(children: list) -> Column:
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(i).alias("id"), F.lit(w).alias("weight")) for n, i, w in children)).cast(T.ArrayType(_CHILD, False))


def _draw(key: Column, children: Column) -> Column:
    """The id of the child with the least -ln(u) / weight; u has 52 bits of md5(key|child)."""

    def cost(c: Column) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), c["name"])), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
        return F.struct((-F.ln(u) / c["weight"]).alias("cost"), c["id"].alias("id"))

    return F.array_min(F.transform(F.filter(children, lambda c: c["weight"] > 0), cost))["id"]


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    top, middle, bottom = levels(tree)
    region = _draw(key, _literal(top))
    rack = _draw(key, F.element_at(F.array(*map(_literal, middle)), region + 1))
    return _draw(key, F.element_at(F.array(*map(_literal, bottom)), rack + 1))


def assign_shards(docs: DataFrame, tree: Sequence[Leaf]) -> DataFrame:
    """Adds shard, grown_shard and slot to the rows' doc_id, size and text_crc32.

    The doc_id (null: empty text) alone decides the shard, so repeated ids share one, and equal texts of different ids may part. A null text has size 1
    and the crc32 of no bytes, 0; an empty text likewise. An empty table gives no rows. Other columns of the input are left out, whatever their names.
    Slots number a shard's rows without gaps: rows are numbered within each of 4096 buckets of a shard, hashed from id and text, and moved up by the counts of the buckets
    before, so that a task sorts only a bucket, and rows that share an id, null included, part by their texts. The counts, at most 4096 a shard, are broadcast.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32")).withColumn("_key", id_text(F.col("doc_id")))
    bucket = F.substring(F.md5(F.concat(F.lit("slot|"), F.col("_key"), F.lit("|"), F.col("text_crc32").cast("string"))), 1, BUCKETS_HEX)
    rows = rows.withColumns({"shard": shard_of(F.col("_key"), tree), "_bucket": bucket})
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("shard", "_bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    # Bounded by shards x 4096 rows, whatever the input.
    return (
        rows.withColumn("grown_shard", shard_of(F.col("_key"), grown(tree)))
        .withColumn("_i", F.row_number().over(own).cast("long") - 1)
        .join(F.broadcast(offsets), ["shard", "_bucket"], "left")
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_i")).alias("slot"), "grown_shard")
    )


SHARDS = 8


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), balanced_tree(SHARDS))


def _sql_draw(children: list) -> str:
    costs = ", ".join(f"{{'c': -ln((('0x' || md5(k || '|{n}')[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / {w}::DOUBLE, 'i': {i}}}" for n, i, w in children)
    return f"list_sort([{costs}])[1].i"


def _sql_shard(tree: Sequence[Leaf], region: str, rack: str) -> tuple[str, str, str]:
    top, middle, bottom = levels(tree)
    case = lambda at, nodes: f"CASE {at} " + " ".join(f"WHEN {i} THEN {_sql_draw(x)}" for i, x in enumerate(nodes)) + " END"
    return _sql_draw(top), case(region, middle), case(rack, bottom)


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
        out.append(n)
    return out


def _oracle() -> str:
    a, b, c = _sql_shard(balanced_tree(SHARDS), "region", "rack")
    d, e, f = _sql_shard(grown(balanced_tree(SHARDS)), "gregion", "grack")
    crc = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(t))), lambda i: ('0x' || hex(encode(t))[2*i+1:2*i+2])::BIGINT)),
      lambda s, x: xor(list_extract(CAST({_crc_table()} AS BIGINT[]), (xor(s, x) & 255) + 1), s >> 8)), 4294967295::BIGINT)"""
    return f"""
WITH texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
crcs AS (SELECT t, {crc} AS crc FROM texts),
keys AS (SELECT doc_id, coalesce(text, '') AS t, (coalesce(strlen(text), 0) + 1)::BIGINT AS size, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
l1 AS (SELECT *, {a} AS region, {d} AS gregion FROM keys),
l2 AS (SELECT *, {b} AS rack, {e} AS grack FROM l1),
l3 AS (SELECT *, {c} AS shard, {f} AS grown_shard FROM l2)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5('slot|' || k || '|' || crc)[1:{BUCKETS_HEX}], doc_id NULLS FIRST, crc, size) - 1 AS slot, grown_shard::INT AS grown_shard
FROM l3 JOIN crcs USING (t)"""


ORACLE_SQL = _oracle()
