"""Sparse matrices as coordinates (image_id, i, j, v) and vectors as (image_id, i, v)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sum_duplicates(coo: DataFrame) -> DataFrame:
    return coo.groupBy("image_id", "i", "j").agg(F.sum("v").alias("v"))


def row_sum(coo: DataFrame) -> DataFrame:
    return coo.groupBy("image_id", "i").agg(F.sum("v").alias("v"))


def normalize_rows(coo: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Entries divided by their row's sum; rows whose sum is under the threshold, or 0, stay as they are."""
    s = F.sum("v").over(Window.partitionBy("image_id", "i"))
    return coo.withColumn("_s", s).select("image_id", "i", "j", F.when((F.col("_s") >= threshold) & (F.col("_s") != 0), F.col("v") / F.col("_s")).otherwise(F.col("v")).alias("v"))


def transpose(coo: DataFrame) -> DataFrame:
    return coo.select("image_id", F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matvec(coo: DataFrame, vec: DataFrame) -> DataFrame:
    """Rows without entries are absent from the result."""
    p = vec.select("image_id", F.col("i").alias("j"), F.col("v").alias("_p"))
    return coo.join(p, ["image_id", "j"]).groupBy("image_id", "i").agg(F.sum(F.col("v") * F.col("_p")).alias("v"))


def matmat(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("image_id", "i", F.col("j").alias("k"), F.col("v").alias("_a"))
    right = b.select("image_id", F.col("i").alias("k"), "j", F.col("v").alias("_b"))
    return left.join(right, ["image_id", "k"]).groupBy("image_id", "i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def scaled(coo: DataFrame, by: float) -> DataFrame:
    return coo.withColumn("v", F.col("v") * F.lit(by))


def add(*parts: DataFrame) -> DataFrame:
    """The sum of matrices, duplicates added up."""
    return sum_duplicates(reduce(DataFrame.unionByName, (p.select("image_id", "i", "j", "v") for p in parts)))


def diagonal(vec: DataFrame) -> DataFrame:
    return vec.select("image_id", "i", F.col("i").alias("j"), "v")


def diag(coo: DataFrame) -> DataFrame:
    return coo.filter(F.col("i") == F.col("j")).groupBy("image_id", "i").agg(F.sum("v").alias("v"))


def block(parts: dict[tuple[int, int], DataFrame], n: Column) -> DataFrame:
    """A matrix of blocks, each moved by its place times n, an expression over the parts' columns."""
    return reduce(DataFrame.unionByName, (p.select("image_id", (F.col("i") + n * r).alias("i"), (F.col("j") + n * c).alias("j"), "v") for (r, c), p in sorted(parts.items())))


def restrict(coo: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Entries whose row is in rows and whose column is in cols (image_id, i)."""
    return coo.join(rows.select("image_id", "i"), ["image_id", "i"], "left_semi").join(cols.select("image_id", F.col("i").alias("j")), ["image_id", "j"], "left_semi").select("image_id", "i", "j", "v")


def symmetrised(edges: DataFrame) -> DataFrame:
    return edges.select("image_id", "i", "j", "v").unionByName(transpose(edges))


def csr(coo: DataFrame) -> DataFrame:
    """A row per matrix row: its sorted column numbers and values."""
    row = F.array_sort(F.collect_list(F.struct("j", "v")))
    return sum_duplicates(coo).groupBy("image_id", "i").agg(row.alias("_r")).select("image_id", "i", F.col("_r.j").alias("indices"), F.col("_r.v").alias("data"))


def jacobi_step(coo: DataFrame, b: DataFrame, x: DataFrame, omega: float) -> DataFrame:
    """x + omega (b - A x) / diag(A). b and x hold every place."""
    product, d = matvec(coo, x).withColumnRenamed("v", "_ax"), diag(coo).withColumnRenamed("v", "_d")
    rows = x.join(b.withColumnRenamed("v", "_b"), ["image_id", "i"]).join(d, ["image_id", "i"]).join(product, ["image_id", "i"], "left")
    return rows.select("image_id", "i", (F.col("v") + omega * (F.col("_b") - F.coalesce("_ax", F.lit(0.0))) / F.col("_d")).alias("v"))


def restriction(sizes: DataFrame) -> DataFrame:
    """make_P of images (image_id, h, w): 1-2-1 weights both ways at every second pixel, places outside dropped."""
    h2, w2 = F.expr("h DIV 2"), F.expr("w DIV 2")
    coarse = sizes.withColumns({"h2": h2, "w2": w2}).filter((F.col("h2") > 0) & (F.col("w2") > 0)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h2") * F.col("w2") - 1)))
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit((2 - abs(dy)) * (2 - abs(dx)) / 16.0).alias("v")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    fan = coarse.withColumn("_o", F.explode(offsets)).select("image_id", "h", "w", "w2", "i", "_o.*")
    fan = fan.withColumns({"y": F.expr("2 * (i DIV w2)") + F.col("dy"), "x": 2 * (F.col("i") % F.col("w2")) + F.col("dx")})
    inside = fan.filter(F.col("y").between(0, F.col("h") - 1) & F.col("x").between(0, F.col("w") - 1))
    return inside.select("image_id", "i", (F.col("y") * F.col("w") + F.col("x")).alias("j"), "v")
