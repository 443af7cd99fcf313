"""Rasters made of tables: a row per pixel, with image_id, y, x and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an image that the stacked raster is cut into.
ROWS = 50

#: Images of a task.
PER_TASK = 16


def raster(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """image_id, y, x, v: embeddings as rows of a gray raster, rescaled to [0, 1], cut into images of ROWS rows. The range is one row, so its join is a broadcast.

    dealt: the table's rows, still whole, are dealt by image, so that what is framed and grouped within images is not shuffled again. The number of tasks grows with that of images
    (PER_TASK each), as what is made of a pixel later is far larger than what is dealt.
    """
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("y"), "embedding")
    e = e.select(F.floor(F.col("y") / ROWS).cast("long").alias("image_id"), (F.col("y") % ROWS).alias("y"), "embedding")
    if dealt:
        images = -(-table(spark, sf_dir, "embeddings").count() // ROWS)
        e = e.repartition(max(1, -(-images // PER_TASK), min(images, 2 * spark.sparkContext.defaultParallelism)), "image_id")
    e = e.select("image_id", "y", F.posexplode("embedding").alias("x", "e"))
    ends = table(spark, sf_dir, "embeddings").agg(F.min(F.array_min("embedding")).cast("double").alias("lo"), F.max(F.array_max("embedding")).cast("double").alias("hi"))
    return e.crossJoin(F.broadcast(ends)).select("image_id", "y", "x", ((F.col("e").cast("double") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("v"))


def rgb(spark: SparkSession, sf_dir: str, width: int = 21) -> DataFrame:
    """image_id, y, x, r, g, b: three stripes of the raster as channels, dealt by image. One aggregation puts a pixel's channels together."""
    s = raster(spark, sf_dir, dealt=True).filter(F.col("x") < 3 * width)
    channel = lambda k: F.max(F.when(F.floor(F.col("x") / width) == k, F.col("v")))
    return s.groupBy("image_id", "y", (F.col("x") % width).alias("x")).agg(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def with_trimap(pixels: DataFrame, fg: int = 2, bg: int = 18) -> DataFrame:
    """Adds t: columns up to fg are foreground, from bg on background, the others unknown."""
    return pixels.withColumn("t", F.when(F.col("x") <= fg, F.lit(1.0)).when(F.col("x") >= bg, F.lit(0.0)).otherwise(F.lit(0.5)))


#: Foreground and background colour of composites, and how much of the raster's noise lies over them.
FOREGROUND, BACKGROUND, NOISE = (0.9, 0.2, 0.1), (0.1, 0.4, 0.8), 0.05


def composite(tri: DataFrame, fg: int = 2, bg: int = 18) -> DataFrame:
    """image_id, y, x, r, g, b, t, alpha: of pixels with a trimap, images of two colours whose alpha falls from 1 at column fg to 0 at column bg, with the pixels as noise."""
    alpha = 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("x") - fg) / float(bg - fg)))
    mixed = lambda c, f, b: F.col("alpha") * f + (1 - F.col("alpha")) * b + NOISE * (F.col(c) - 0.5)
    return tri.withColumn("alpha", alpha).select("image_id", "y", "x", *(mixed(c, f, b).alias(c) for c, f, b in zip("rgb", FOREGROUND, BACKGROUND, strict=True)), "t", "alpha")


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, v: mean discount by part and quantity on a dense 32 x 50 grid, 0 where there is none."""
    cells = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 32).cast("int").alias("y"), (F.floor("l_quantity").cast("int") - 1).alias("x"))
    cells = cells.agg((F.avg(F.col("l_discount").cast("double")) * 10).alias("v"))
    grid = spark.range(32 * 50).select((F.col("id") / 50).cast("int").alias("y"), (F.col("id") % 50).cast("int").alias("x"))
    return grid.join(cells, ["y", "x"], "left").select(F.lit(0).cast("long").alias("image_id"), "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))


#: The same views for DuckDB, as the first part of a WITH clause.
SQL = f"""
pix AS (SELECT vec_id, CAST(p AS INT) AS x, CAST(embedding[p + 1] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(64)) AS p FROM embeddings)),
raster AS (SELECT CAST(vec_id // {ROWS} AS BIGINT) AS image_id, CAST(vec_id % {ROWS} AS INT) AS y, x, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS v FROM pix),
rgb AS (SELECT a.image_id, a.y, a.x, a.v AS r, b.v AS g, c.v AS b FROM raster a JOIN raster b ON b.image_id = a.image_id AND b.y = a.y AND b.x = a.x + 21
  JOIN raster c ON c.image_id = a.image_id AND c.y = a.y AND c.x = a.x + 42 WHERE a.x < 21),
tri AS (SELECT *, CASE WHEN x <= 2 THEN 1.0::DOUBLE WHEN x >= 18 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS t FROM rgb)"""

COMPOSITE_SQL = (
    "comp AS MATERIALIZED (SELECT image_id, y, x, t, alpha, "
    + ", ".join(f"alpha * {f}::DOUBLE + (1 - alpha) * {b}::DOUBLE + {NOISE}::DOUBLE * ({c} - 0.5::DOUBLE) AS {c}" for c, f, b in zip("rgb", FOREGROUND, BACKGROUND, strict=True))
    + " FROM (SELECT *, 1 - greatest(0.0::DOUBLE, least(1.0::DOUBLE, (x - 2) / 16.0::DOUBLE)) AS alpha FROM tri))"
)

HEAT_SQL = """
cells AS (SELECT CAST(l_partkey % 32 AS INT) AS y, CAST(floor(l_quantity) AS INT) - 1 AS x, avg(CAST(l_discount AS DOUBLE)) * 10 AS v FROM lineitem GROUP BY 1, 2),
heat AS (SELECT 0::BIGINT AS image_id, g.y, g.x, coalesce(v, 0.0::DOUBLE) AS v FROM (SELECT CAST(i // 50 AS INT) AS y, CAST(i % 50 AS INT) AS x FROM range(1600) t(i)) g LEFT JOIN cells USING (y, x))"""
