"""Near-duplicate documents by SetSketch registers: banded for candidates, estimated by likelihood, verified on the full shingle sets.

Equal shingle sets are one class, so that groups of copies cost one row. Every band's bucket links its classes to its least one, a star; verified links give components;
what a bucket still holds apart is compared in blocks, as bit sets, and only links that join two components leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alphaloom.llm import shingles
from alphaloom.llm.common import in_parts, removed, table, written

#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Ids of candidates up to this count are broadcast (8 bytes each); more are shuffled.
BROADCAST_IDS = 1_000_000
#: Bytes of shingle sets in one block of a bucket.
BLOCK_BYTES = 8 << 20

SKETCH = "doc_id long, n_shingles long, key binary, bands array<long>, registers binary"


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _sketched(percent: int):
    rows, number = shingles.layout(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            ids, texts = batch.column(0), _texts(batch.column(1))
            for at, some in shingles.in_groups(texts):
                sets = shingles.shingle_sets(some)
                sketches = [shingles.registers(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(some)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([shingles.digest(s) for s in sets], pa.binary()),
                        pa.array([shingles.bands(k, rows, number) if len(s) else [] for s, k in zip(sets, sketches, strict=True)], pa.list_(pa.int64())),
                        pa.array([k.tobytes() for k in sketches], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "key", "bands", "registers"],
                )

    return run


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row per document: set size, the set's digest as key, band keys for pairs at the similarity, and registers."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketched(percent), SKETCH)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        for _, some in shingles.in_groups(_texts(batch.column(0))):
            sets = shingles.shingle_sets(some)
            yield pa.RecordBatch.from_arrays([pa.array([shingles.digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "set"])


def _likely(percent: int):
    least = shingles.least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                x = batch.slice(i, 2048)
                a, b = (np.frombuffer(b"".join(x.column(n).to_pylist()), np.uint16).reshape(-1, shingles.REGISTERS) for n in ("ra", "rb"))
                j = shingles.estimate(a, b, x.column("na").to_numpy(), x.column("nb").to_numpy())
                yield x.select(["a", "b"]).filter(pa.array(j >= least))

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node that its component holds, of the nodes of edges (a, b).

    Each round gives every node the least of itself and its neighbours as parent, follows parents four steps, and contracts the edges to the parents' ends; it stops when
    none is left. Each round's tables are written, so that hot nodes meet in joins of tables, which Spark splits.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("parent")), "parents")
        parent = first
        for _ in range(2):
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
            parent = parent.join(up, "parent").select("node", F.col("root").alias("parent"))
        parent = written(parent, "parents")
        removed(first)
        if labels is None:
            labels = written(parent.withColumnRenamed("parent", "label"), "labels")
        else:
            up, old = parent.select(F.col("node").alias("label"), "parent"), labels
            labels = written(old.join(up, "label", "left").select("node", F.coalesce("parent", "label").alias("label")), "labels")
            removed(old)
        pa_, pb = (parent.select(F.col("node").alias(x), F.col("parent").alias(f"p{x}")) for x in ("a", "b"))
        moved, old = edges.join(pa_, "a").join(pb, "b").filter("pa <> pb"), edges
        edges = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        removed(old, parent)
        if edges.isEmpty():
            removed(edges)
            return labels


def _popcount_rows(bits: np.ndarray, row: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits & row).sum(axis=1, dtype=np.int64)


def block_links(sets: list[np.ndarray], labels: list[bytes], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between sets of different labels, as few as join the labels as all links would. sides: only sets of different sides are compared, unless all are of one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    everything = np.concatenate(sets)
    values, where, count = np.unique(everything, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    width = max(1, int(shared.sum()))
    rows = np.repeat(np.arange(len(sets)), sizes)
    keep = shared[where]
    cols, rows = place[where][keep], rows[keep]
    bits = np.zeros((len(sets), -(-width // 64)), np.uint64)
    np.bitwise_or.at(bits, (rows, cols >> 6), np.uint64(1) << (cols & 63).astype(np.uint64))
    names = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    of = np.array([names[x] for x in labels])
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    side = np.array(sides)
    one = len(set(sides)) == 1
    largest = np.bincount(of).argmax()
    out = []
    for x in np.flatnonzero(of != largest).tolist():  # any link has an end outside the largest label
        other = (of != of[x]) & ((side != side[x]) | one) & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x]))
        ys = np.flatnonzero(other)
        for i in range(0, len(ys), 4096):
            some = ys[i : i + 4096]
            inter = _popcount_rows(bits[some], bits[x])
            for y in some[100 * inter >= percent * (sizes[some] + sizes[x] - inter)].tolist():
                p, q = find(of[x]), find(of[y])
                if p != q:
                    root[p] = q
                    out.append((x, y))
    return out


def _closed(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in rows["set"]]
        links = block_links(sets, list(rows["label"]), list(rows["side"]), percent)
        return pd.DataFrame({"a": [rows["label"].iloc[x] for x, _ in links], "b": [rows["label"].iloc[y] for _, y in links]}, columns=["a", "b"])

    return run


def _sets_of(docs: DataFrame, classes: DataFrame, keys: DataFrame) -> DataFrame:
    """key and set of the classes named in keys, hashed again from one document's text each."""
    wanted = written(classes.join(keys, "key", "left_semi").select(F.col("min_id").alias("_id")), "ids")
    n = wanted.count()
    ids = F.broadcast(wanted) if n <= BROADCAST_IDS else wanted
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi")
    return written(texts.select("text").mapInArrow(_sets, "key binary, set binary").join(keys, "key", "left_semi").dropDuplicates(["key"]), "sets")


def _block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """band, i, j, side, label, set: the members of each bucket (band, key, label, n, set) in every pair of blocks i <= j that can hold a link.

    Blocks hold about BLOCK_BYTES of sets and go by set size, so that blocks whose sizes are too far apart for a link never meet. A size that fills more than a block is
    spread over several by hash.
    """
    sizes = members.groupBy("band", "n").agg(F.sum(8 * F.col("n")).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("band").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    block = lambda x: F.floor(x / BLOCK_BYTES).cast("int")
    sizes = sizes.select("band", "n", block(before).alias("first"), block(before + F.col("bytes") - 1).alias("last"))
    own = F.col("first") + F.pmod(F.xxhash64("key"), F.col("last") - F.col("first") + 1).cast("int")
    placed = written(members.join(sizes, ["band", "n"]).select("band", "label", "set", "n", own.alias("own")), "placed")
    ranges = written(placed.groupBy("band", "own").agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "ranges")
    left, right = (ranges.select("band", F.col("own").alias(x), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}")) for x in "ij")
    pairs = written(left.join(right, "band").filter("i <= j").filter(percent * F.col("lo_j") <= 100 * F.col("hi_i")).select("band", "i", "j"), "pairs")
    of = lambda x, which: placed.join(which.withColumn("own", F.col(x)), ["band", "own"]).select("band", "i", "j", F.col("own").alias("side"), "label", "set")
    return of("i", pairs).unionAll(of("j", pairs.filter("i < j")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per document.

    Words and sets are those of shingles.shingle_sets(). A null or empty text, or one of only white space, has an empty set and is linked with nothing. Repeated rows are
    copies; of documents that share the smallest id all are kept. Null ids take part in links but name a component only if it has no other. An empty table gives no rows.
    Other columns are left out.

    Two sets at exactly the similarity share no band with a probability of at most shingles.MISS (7.7e-7 at 85 per cent, 1.4e-7 at 80), and less at any higher one. Those
    that share one are decided on their full sets: in a bucket of two unless the estimate is so low that it happens once in 1e9 such pairs (shingles.UNDER), in a larger
    one always, by its least set or with all others.
    """
    found = written(sketches(docs, percent), "sketches")
    classes = written(found.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("min_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("registers").alias("registers")), "classes")
    banded = classes.select("key", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("key").alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(banded.join(written(buckets, "buckets"), "band"), "members")

    pairs = members.filter("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct()
    slim = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    likely = written(pairs.join(slim("a"), "a").join(slim("b"), "b").mapInArrow(_likely(percent), "a binary, b binary"), "likely")

    sets = _sets_of(docs, classes, likely.select(F.col("a").alias("key")).unionAll(likely.select(F.col("b").alias("key"))).distinct())
    side = lambda x: sets.select(F.col("key").alias(x), F.col("set").alias(f"s{x}"))
    links = likely.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verified(percent), "a binary, b binary")
    labels = components(links)

    # Buckets that still hold classes of different components; of those with the same members, one.
    named = members.filter("size > 2").join(labels.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("label", "key").alias("label"))
    named = written(named, "named")
    mixed = named.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).filter("l <> m")
    mixed = written(mixed.groupBy("size", "x", "y").agg(F.min("band").alias("band")).select("band"), "mixed")
    if not mixed.isEmpty():
        apart = written(named.join(mixed, "band").join(classes.select("key", "n"), "key"), "apart")
        sets = _sets_of(docs, classes, apart.select("key").distinct())
        spread = _block_pairs(apart.join(sets, "key"), percent)
        more = spread.groupBy("band", "i", "j").applyInPandas(_closed(percent), "a binary, b binary")
        joined = components(more)
        up = joined.select(F.col("node").alias("label"), F.col("label").alias("top"))
        old = labels.select("node", "label").unionAll(joined.select("node", F.col("node").alias("label")).join(labels.select("node"), "node", "left_anti"))
        labels = written(old.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
        removed(apart, sets)

    names = classes.select("key", "min_id").join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "min_id", F.coalesce("label", "key").alias("label"))
    names = written(names, "names")
    least = written(names.groupBy("label").agg(F.min("min_id").alias("component_id")), "least")
    of = written(names.join(least, "label").select("key", "component_id"), "components")
    removed(classes, members, likely, labels, named, mixed, names, least)
    out = found.select("doc_id", "n_shingles", "key").join(of, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs),
ranked AS (SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM shingles),
sizes AS (SELECT doc_id, count(*) AS n FROM ranked GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM ranked x JOIN ranked y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(b) AS component_id, d.doc_id = min(b) AS kept
FROM docs d JOIN reach ON a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id, n"""
