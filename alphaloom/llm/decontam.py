"""Benchmark decontamination: item-sized windows of documents that hold a seed shingle of an item, verified exactly by weighted shingles.

1. Seeds: of each item the fewest, heaviest shingles whose weight together exceeds the share that a similar window may lack. A window that reaches the threshold holds one
   of them, wherever it stands in the window, so that all item-sized windows around each place of a seed are looked at and none that could pass is lost.
2. Verification: the weighted Jaccard similarity of the two shingle sets, a shingle weighing as many as its words have letters, of all these windows by sliding sums,
   compared as whole numbers.
3. SimHash: 64 weighted bits of the item and of its most similar window. Their Hamming distance is given, but rejects nothing: one edit in heavy shingles costs more bits
   than the radius of an index with a bearable number of blocks and masks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from alphaloom.llm.common import bound, removed, table, written

WORDS = 5
#: Similar: PARTS[1] * shared weight >= PARTS[0] * weight of the union.
PARTS = (4, 5)
THRESHOLD = PARTS[0] / PARTS[1]
#: Rows of ids and hashes (at most 50 bytes each), and bytes of items' shingles, that are broadcast at most; more are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; one empty word if there is none."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def shingles(of: Column, k: Column) -> Column:
    """The distinct shingles of an array of words, as array<struct<h, w>>: hash and weight. None if it has under k words."""
    part = lambda i: F.slice(of, i + 1, k)
    one = lambda i: F.struct(F.xxhash64(part(i)).alias("h"), F.length(F.array_join(part(i), "")).cast("long").alias("w"))
    none = F.array().cast("array<struct<h:long,w:long>>")
    return F.when(F.size(of) >= k, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(of) - k), one))).otherwise(none)


def fingerprint(ws: Column, k: Column) -> Column:
    """SimHash of the distinct shingles of an array of words: two numbers of 32 bits. A bit is set if the shingles that have it in their md5 outweigh the others."""
    text = lambda i: F.array_join(F.slice(ws, i + 1, k), " ")
    half = lambda s, n: F.conv(F.substring(F.md5(s), 1 + 8 * n, 8), 16, 10).cast("long")
    one = lambda s: F.struct(F.length(F.replace(s, F.lit(" "), F.lit(""))).cast("long").alias("w"), half(s, 0).alias("a"), half(s, 1).alias("b"))

    def bits(of: Column, side: str) -> Column:
        def bit(p: Column) -> Column:
            lean = F.aggregate(of, F.lit(0).cast("long"), lambda s, x: s + F.when(F.call_function("getbit", x[side], p) == 1, x["w"]).otherwise(-x["w"]))
            return F.when(lean > 0, F.call_function("shiftleft", F.lit(1).cast("long"), p)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, p: s + bit(p))

    distinct = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(ws) - k), text))
    return bound(F.transform(distinct, one), lambda of: F.array(bits(of, "a"), bits(of, "b")))


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def weight(of: Column) -> Column:
    return F.aggregate(of, F.lit(0).cast("long"), lambda s, x: s + x["w"])


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, n words, k of its shingles, shingles, fp, and seeds (place in the item). Items without words are no items."""
    rows = benchmark.select("item_id", words(F.col("text")).alias("ws")).filter(F.get("ws", F.lit(0)) != "")
    rows = rows.withColumn("n", F.size("ws")).withColumn("k", F.least("n", F.lit(WORDS)))
    rows = rows.select("item_id", "n", "k", "ws", shingles(F.col("ws"), F.col("k")).alias("sh")).distinct()
    return rows.withColumn("fp", fingerprint(F.col("ws"), F.col("k")))


def number(of: DataFrame) -> DataFrame:
    """item: a number of each row of items()."""
    return of.withColumn("item", F.xxhash64("item_id", "ws"))


def seeds(of: DataFrame) -> DataFrame:
    """h, k, n, item: the shingles that stand for each item: those before which at most the share that a similar window may lack is left out."""
    each = number(of).select("item", "n", "k", F.explode("sh").alias("s")).select("item", "n", "k", "s.h", "s.w")
    item = Window.partitionBy("item")
    before = F.sum("w").over(item.orderBy(F.col("w").desc(), "h").rowsBetween(Window.unboundedPreceding, -1))
    chosen = each.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_all", F.sum("w").over(item)).filter(PARTS[1] * F.col("_before") <= (PARTS[1] - PARTS[0]) * F.col("_all"))
    return chosen.select("h", "k", "n", "item")


def _near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def best_window(region: Column, k: Column, n: Column, item: Column) -> Column:
    """The most similar of all windows of n words in region, as struct<both, either, at>: the weights of the shared shingles and of the union, and the window's place in the
    region; of equal ones the first. item: the item's shingles.

    Sums slide: a shingle leaves unless it stands in the window again, and one that enters counts unless it stands there already.
    """
    part = lambda i: F.slice(region, i + 1, k)
    places = F.sequence(F.lit(0), F.size(region) - k)
    hs = F.transform(places, lambda i: F.xxhash64(part(i)))
    wanted, total = F.transform(item, lambda x: x["h"]), weight(item)

    def described(hs: Column) -> Column:
        once = F.size(F.array_distinct(hs)) == F.size(hs)

        def one(i: Column) -> Column:
            h = F.get(hs, i)
            w = F.length(F.array_join(part(i), "")).cast("long")
            back = F.when(once, 0).otherwise(F.array_position(F.reverse(F.slice(hs, F.lit(1), i)), h))
            on = F.when(once, 0).otherwise(F.array_position(F.slice(hs, i + 2, F.size(hs)), h))
            near = lambda x, y, none: F.when(x == 0, none).otherwise(y).cast("long")
            return F.struct(w.alias("w"), F.when(F.array_contains(wanted, h), w).otherwise(F.lit(0).cast("long")).alias("m"), near(back, i - back, -1).alias("before"), near(on, i + on, 1 << 31).alias("after"))

        return F.transform(places, one)

    def slide(e: Column) -> Column:
        last = n - k
        zero = F.lit(0).cast("long")
        first = F.filter(F.slice(e, F.lit(1), last + 1), lambda x: x["after"] > last)
        both, own = F.aggregate(first, zero, lambda t, x: t + x["m"]), F.aggregate(first, zero, lambda t, x: t + x["w"])
        state = lambda both, own, best, of, at: F.struct(both.alias("both"), own.alias("own"), best.alias("best"), of.alias("of"), at.cast("int").alias("at"))

        def step(t: Column, i: Column) -> Column:
            out, into = F.get(e, i - 1), F.get(e, i + last)
            goes, comes = out["after"] > i - 1 + last, into["before"] < i
            moved = lambda f: t["both" if f == "m" else "own"] - F.when(goes, out[f]).otherwise(zero) + F.when(comes, into[f]).otherwise(zero)
            b, o = moved("m"), moved("w")
            either = o + total - b
            better = b * t["of"] > t["best"] * either
            return state(b, o, F.when(better, b).otherwise(t["best"]), F.when(better, either).otherwise(t["of"]), F.when(better, i).otherwise(t["at"]))

        more = F.filter(F.sequence(F.lit(0), F.size(region) - n), lambda i: i > 0)
        return bound(F.struct(both.alias("b"), own.alias("o")), lambda x: F.aggregate(more, state(x["b"], x["o"], x["b"], x["o"] + total - x["b"], F.lit(0)), step))

    found = bound(hs, lambda x: bound(described(x), slide))
    return F.struct(found["best"].alias("both"), found["of"].alias("either"), found["at"].alias("at"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start (word of the most similar window, of equal ones the first), hamming: a row for each pair that reaches THRESHOLD in some window.

    A window has as many words as the item, or the whole document if that is shorter. Null and empty texts, and items without words, are in no pair. Repeated documents or
    items give one pair; null ids count as ids, and texts under one id are looked at each by itself. Empty tables give no rows; other columns are left out. hamming is the
    distance of the two fingerprints, of 64.
    """
    bench = written(items(benchmark), "items")
    start = written(seeds(bench), "seeds")
    n_bytes, n_seeds = bench.agg(F.sum(16 * F.size("sh") + 100)).first()[0] or 0, start.count()
    sizes = [r.k for r in bench.select("k").distinct().collect()]  # at most WORDS
    text = docs.select("doc_id", F.xxhash64("text").alias("own"), words(F.col("text")).alias("ws")).withColumn("_n", F.size("ws"))
    found = None
    for k in sizes:
        at = text.select("doc_id", "own", "ws", "_n", F.posexplode("ws").alias("pos", "_w")).filter(F.col("pos") <= F.col("_n") - k)
        at = at.withColumn("h", F.xxhash64(*(F.get("ws", F.col("pos") + i) for i in range(k))))
        at = at.select("doc_id", "own", "_n", "pos", "h")  # no words in the shuffle that a large set of seeds takes
        some = at.join(_near(start.filter(F.col("k") == k), n_seeds), "h").select("doc_id", "own", "_n", "item", "n", "k", "pos")
        found = some if found is None else found.unionAll(some)
    if found is None:
        ids = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType)]
        return docs.sparkSession.createDataFrame([], T.StructType([*ids, T.StructField("similarity", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("hamming", T.IntegerType())]))

    # Every window that holds a seed, under the first seed in it: from lo to hi.
    hits = found.distinct()
    before = F.lag("pos").over(Window.partitionBy("doc_id", "own", "item").orderBy("pos"))
    short = F.col("_n") < F.col("n")
    lo = F.when(short, F.when(F.col("before").isNull(), 0).otherwise(1)).otherwise(F.greatest(F.lit(0), F.col("pos") - F.col("n") + F.col("k"), F.coalesce(F.col("before") + 1, F.lit(0))))
    hi = F.when(short, 0).otherwise(F.least("pos", F.col("_n") - F.col("n")))
    ranges = hits.withColumn("before", before).select("doc_id", "own", "item", "k", F.least("n", "_n").alias("n"), lo.alias("lo"), hi.alias("hi")).filter("lo <= hi")
    ranges = written(ranges, "ranges")
    each = F.collect_list(F.struct("item", "k", "n", "lo", "hi")).alias("ranges")
    held = written(ranges.groupBy(F.col("doc_id").alias("_doc"), F.col("own").alias("_own")).agg(each), "held")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("own") == F.col("_own"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("own")).join(_near(held.select("_doc", "_own"), held.count()), same, "left_semi")
    texts = texts.join(held, same).select("doc_id", words(F.col("text")).alias("ws"), "ranges")
    region = lambda ws, r: F.slice(ws, r["lo"] + 1, r["hi"] - r["lo"] + r["n"])
    cut = F.transform(F.array("ws"), lambda ws: F.transform("ranges", lambda r: F.struct(r["item"].alias("item"), r["k"].alias("k"), r["n"].alias("n"), r["lo"].alias("lo"), region(ws, r).alias("region"))))
    windows = texts.select("doc_id", F.explode(F.flatten(cut)).alias("r")).select("doc_id", "r.*")
    bodies = number(bench).select("item", "item_id", F.col("sh").alias("ish"), F.col("fp").alias("ifp"))
    near = F.broadcast(bodies) if n_bytes <= BROADCAST_BYTES else bodies
    pairs = windows.join(near, "item").withColumn("best", F.explode(F.array(best_window(F.col("region"), F.col("k"), F.col("n"), F.col("ish")))))
    pairs = pairs.filter(PARTS[1] * F.col("best.both") >= PARTS[0] * F.col("best.either"))
    start_at = F.col("lo") + F.col("best.at")
    one = F.struct((F.col("best.both") / F.col("best.either")).alias("similarity"), start_at.alias("start"), F.slice("region", F.col("best.at") + 1, F.col("n")).alias("ws"), "k", "ifp")
    pairs = pairs.groupBy("doc_id", "item_id").agg(F.max_by(one, F.struct(F.col("best.both") / F.col("best.either"), -start_at)).alias("b")).select("doc_id", "item_id", "b.*")
    out = pairs.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start", distance(fingerprint(F.col("ws"), F.col("k")), F.col("ifp")).alias("hamming"))
    removed(start, ranges)
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS_SQL = "string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), ' ') AS w"

ORACLE_SQL = f"""
WITH words AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, w, len(w) AS l FROM (SELECT DISTINCT doc_id, {_WORDS_SQL} FROM documents)),
items AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, w, len(w) AS n, least(len(w), {WORDS}) AS k FROM (SELECT DISTINCT item_id, {_WORDS_SQL} FROM benchmark) WHERE w[1] <> ''),
own AS MATERIALIZED (SELECT DISTINCT i, n, k, array_to_string(w[j:j + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, n - k + 2)) AS j FROM items)),
totals AS (SELECT i, sum(length(replace(s, ' ', '')))::BIGINT AS total FROM own GROUP BY i),
places AS MATERIALIZED (SELECT d, l, k, j - 1 AS pos, array_to_string(w[j:j + k - 1], ' ') AS s FROM (SELECT words.*, k, unnest(range(1, l - k + 2)) AS j FROM words, (SELECT DISTINCT k FROM items))),
hits AS (SELECT d, l, i, n, k, pos FROM places JOIN own USING (k, s)),
starts AS (SELECT DISTINCT d, i, k, least(n, l) AS n, unnest(range(greatest(0, least(pos - n + k, l - n)), least(pos, greatest(l - n, 0)) + 1)) AS start FROM hits),
inside AS (SELECT DISTINCT x.d, x.i, x.start, p.s FROM starts x JOIN places p ON p.d = x.d AND p.k = x.k AND p.pos BETWEEN x.start AND x.start + x.n - x.k),
weighed AS MATERIALIZED (SELECT x.*, length(replace(x.s, ' ', '')) AS v, o.s IS NOT NULL AS shared FROM inside x LEFT JOIN own o ON o.i = x.i AND o.s = x.s),
sums AS (SELECT d, i, start, coalesce(sum(v) FILTER (shared), 0)::BIGINT AS both_, sum(v)::BIGINT AS own_ FROM weighed GROUP BY ALL),
reach AS (SELECT *, own_ + total - both_ AS either FROM sums JOIN totals USING (i) WHERE {PARTS[1]} * both_ >= {PARTS[0]} * (own_ + total - both_)),
best AS MATERIALIZED (SELECT reach.*, doc_id, item_id FROM reach JOIN words USING (d) JOIN items USING (i) QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY both_ / either DESC, start) = 1),
bits AS (SELECT d, i, side, p, sum(CASE WHEN (('0x' || md5(s)[1 + 8 * (p // 32):8 + 8 * (p // 32)])::BIGINT >> (p % 32)) & 1 = 1 THEN v ELSE -v END) > 0 AS set_ FROM (
  SELECT d, i, 0 AS side, s, v FROM best JOIN weighed USING (d, i, start) UNION ALL SELECT d, i, 1, s, length(replace(s, ' ', '')) FROM best JOIN own USING (i)), range(64) r(p) GROUP BY ALL),
hammings AS (SELECT d, i, sum(n - 1)::INT AS hamming FROM (SELECT d, i, p, count(DISTINCT set_) AS n FROM bits GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, item_id, round(both_ / either, 6) AS similarity, start::INT AS start, hamming FROM best JOIN hammings USING (d, i)"""
