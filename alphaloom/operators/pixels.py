"""Pixel-wise operators: expressions and aggregates over (image_id, y, x, values)."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["image_id", "y", "x"]
RGB = ["r", "g", "b"]


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def to_byte(c: Column) -> Column:
    """The byte of a value in [0, 1]: clipped and cut off, not rounded."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c * 255.0))).cast("int")


def trimap_flags(t: Column, bg_threshold: float = 0.1, fg_threshold: float = 0.9) -> dict[str, Column]:
    fg, bg = t >= fg_threshold, t <= bg_threshold
    return {"is_fg": fg, "is_bg": bg, "is_known": fg | bg, "is_unknown": ~(fg | bg)}


def trimap_split(df: DataFrame, bg_threshold: float = 0.1, fg_threshold: float = 0.9, validate: bool = True) -> DataFrame:
    """Adds is_fg, is_bg, is_known and is_unknown of t. With validate, one aggregate: ValueError if an image has no background or no foreground, a warning if values leave [0, 1]."""
    flags = trimap_flags(F.col("t"), bg_threshold, fg_threshold)
    if validate:
        per = df.groupBy("image_id").agg(F.bool_or(flags["is_fg"]).alias("f"), F.bool_or(flags["is_bg"]).alias("b"), F.min("t").alias("lo"), F.max("t").alias("hi"))
        r = per.agg(F.bool_and("f").alias("f"), F.bool_and("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
        if r.lo is not None and (r.lo < 0 or r.hi > 1):
            warnings.warn(f"trimap values should be in [0, 1] but reach from {r.lo} to {r.hi}", stacklevel=2)
        if r.b is False:
            raise ValueError("a trimap has no background")
        if r.f is False:
            raise ValueError("a trimap has no foreground")
    return df.withColumns(flags)


def fix_trimap(df: DataFrame, lower_threshold: float = 0.1, upper_threshold: float = 0.9) -> DataFrame:
    """t to 0 below, 1 above, 0.5 between the thresholds, which belong to the middle."""
    if not 0 <= lower_threshold <= 1:
        raise ValueError(f"invalid lower threshold {lower_threshold}: it must lie in [0, 1]")
    if not 0 <= upper_threshold <= 1:
        raise ValueError(f"invalid upper threshold {upper_threshold}: it must lie in [0, 1]")
    if lower_threshold > upper_threshold:
        raise ValueError("the lower threshold is above the upper one")
    return df.withColumn("t", F.when(F.col("t") < lower_threshold, F.lit(0.0)).when(F.col("t") > upper_threshold, F.lit(1.0)).otherwise(F.lit(0.5)))


def blend(foreground: DataFrame, background: DataFrame | Sequence[float], alpha: DataFrame, channels: Sequence[str] = RGB) -> DataFrame:
    """alpha F + (1 - alpha) B by pixel; the background may be one colour. alpha holds the column alpha."""
    out = foreground.join(alpha.select(*KEY, "alpha"), KEY)
    if isinstance(background, DataFrame):
        out = out.join(background.select(*KEY, *(F.col(c).alias(f"bg_{c}") for c in channels)), KEY)
    else:
        out = out.withColumns({f"bg_{c}": F.lit(float(v)) for c, v in zip(channels, background, strict=True)})
    a = F.col("alpha")
    return out.select(*KEY, *((a * F.col(c) + (1 - a) * F.col(f"bg_{c}")).alias(c) for c in channels))


def remove_background_bicolor(df: DataFrame, fg_color: Sequence[float], bg_color: Sequence[float]) -> DataFrame:
    """r, g, b, a of an image of two colours and their mixtures; colour 0 where alpha is 0."""
    d = [f - b for f, b in zip(fg_color, bg_color, strict=True)]
    square = sum(v * v for v in d)
    along = reduce(lambda s, x: s + x, ((F.col(c) - b) * v for c, b, v in zip(RGB, bg_color, d, strict=True)))
    rows = df.withColumn("a", clip01(along / square))
    a = F.col("a")
    colour = lambda c, b: clip01(F.when(a > 0, (F.col(c) - (1 - a) * b) / a).otherwise(F.lit(0.0)))
    return rows.select(*KEY, *(colour(c, b).alias(c) for c, b in zip(RGB, bg_color, strict=True)), "a")


def to_rgb8(df: DataFrame) -> DataFrame:
    """r, g, b as bytes in INT: of v (gray, three copies) or of r, g, b; alpha is left out. ValueError for other columns."""
    if set(RGB) <= set(df.columns):
        return df.select(*KEY, *(to_byte(F.col(c)).alias(c) for c in RGB))
    if "v" in df.columns:
        return df.select(*KEY, *(to_byte(F.col("v")).alias(c) for c in RGB))
    raise ValueError(f"neither gray nor RGB: {df.columns}")


def normalize(df: DataFrame, column: str = "v") -> DataFrame:
    """To [0, 1] over the whole frame, by a one-row aggregate; 0 if all values are equal."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return df.crossJoin(F.broadcast(ends)).withColumn(column, F.when(span != 0, (F.col(column) - F.col("_lo")) / span).otherwise(F.lit(0.0))).drop("_lo", "_hi")


def stack(frames: Sequence[DataFrame], channels: Sequence[Sequence[str]], names: Sequence[str]) -> DataFrame:
    """The channels of several images side by side, under new names."""
    named, k = [], 0
    for df, own in zip(frames, channels, strict=True):
        named.append(df.select(*KEY, *(F.col(c).alias(n) for c, n in zip(own, names[k : k + len(own)], strict=True))))
        k += len(own)
    return reduce(lambda a, b: a.join(b, KEY), named)


def grid_coordinates(df_range: DataFrame, width: int) -> DataFrame:
    """y and x of a frame of pixel numbers id."""
    return df_range.select(F.expr(f"CAST(id DIV {width} AS INT)").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def sanity_check_image(df: DataFrame, channels: Sequence[str] = RGB) -> list[str]:
    """Warnings about missing or non-floating channels and values outside [0, 1]; never raises."""
    said = []
    kinds = dict(df.dtypes)
    if missing := [c for c in channels if c not in kinds]:
        said.append(f"no column {', '.join(missing)}")
    present = [c for c in channels if c in kinds]
    if any(kinds[c] not in ("double", "float") for c in present):
        said.append("channels should be floating-point numbers")
    if present:
        r = df.agg(F.min(F.least(*present) if len(present) > 1 else F.col(present[0])).alias("lo"), F.max(F.greatest(*present) if len(present) > 1 else F.col(present[0])).alias("hi")).first()
        if r.lo is not None and r.lo < 0:
            said.append(f"least value {r.lo} is below 0")
        if r.hi is not None and r.hi > 1:
            said.append(f"greatest value {r.hi} is above 1")
    for x in said:
        warnings.warn(x, stacklevel=2)
    return said


def apply_to_channels(f: Callable[[DataFrame, str], DataFrame]) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """Lifts an operator on one value column to several: f's result for each channel, put side by side."""

    def lifted(df: DataFrame, channels: Sequence[str]) -> DataFrame:
        return reduce(lambda a, b: a.join(b, KEY), (f(df.select(*KEY, c), c) for c in channels))

    return lifted


def grid_shape(n: int, nx: int | None = None, ny: int | None = None) -> tuple[int, int]:
    """Tiles across and down for n images; the missing number follows from the other, both from the square root."""
    if nx is None and ny is None:
        nx = math.ceil(math.sqrt(n))
    if nx is None:
        nx = -(-n // ny)
    if ny is None:
        ny = -(-n // nx)
    return nx, ny


def make_grid(df: DataFrame, n: int, height: int, width: int, nx: int | None = None, ny: int | None = None, column: str = "v") -> DataFrame:
    """One image of n images (image_id from 0) in tiles of height x width; 0 where there is nothing."""
    nx, ny = grid_shape(n, nx, ny)
    spark = df.sparkSession
    w = nx * width
    dense = grid_coordinates(spark.range(ny * height * w), w)
    placed = df.select((F.expr(f"image_id DIV {nx}") * height + F.col("y")).cast("int").alias("y"), (F.col("image_id") % nx * width + F.col("x")).cast("int").alias("x"), column)
    return dense.join(placed, ["y", "x"], "left").select(F.lit(0).cast("long").alias("image_id"), "y", "x", F.coalesce(column, F.lit(0.0)).alias(column))


def mean_colours(df: DataFrame, channels: Sequence[str] = RGB) -> DataFrame:
    """Of each image the mean colour where alpha > 0.9 and where alpha < 0.1, with 1e-5 in the denominators."""
    at = lambda cond: [(F.sum(F.when(cond, F.col(c)).otherwise(0.0)) / (F.count(F.when(cond, 1)) + 1e-5)) for c in channels]
    fg, bg = at(F.col("alpha") > 0.9), at(F.col("alpha") < 0.1)
    return df.groupBy("image_id").agg(*(e.alias(f"f_{c}") for e, c in zip(fg, channels, strict=True)), *(e.alias(f"b_{c}") for e, c in zip(bg, channels, strict=True)))


def known_means(df: DataFrame, channels: Sequence[str] = RGB) -> DataFrame:
    """Of each image the mean colour where t is exactly 1 and exactly 0."""
    of = lambda v, p: [F.avg(F.when(F.col("t") == v, F.col(c))).alias(f"{p}_{c}") for c in channels]
    return df.groupBy("image_id").agg(*of(1.0, "f"), *of(0.0, "b"))


def error_metrics(df: DataFrame, a: str, b: str, weight: str | None = None, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Of two columns: L2 norm, mean square, largest and (weighted) mean absolute difference."""
    d = F.col(a) - F.col(b)
    w = F.lit(1.0) if weight is None else F.col(weight)
    total = F.sum(w)
    mean = F.when(total != 0, F.sum(w * F.abs(d)) / total)
    return df.groupBy(*by).agg(F.sqrt(F.sum(d * d)).alias("l2"), F.avg(d * d).alias("mse"), F.max(F.abs(d)).alias("max_abs"), mean.alias("mean_abs"), F.count(F.lit(1)).alias("n"))


def solver_statistics(records: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean, population deviation and maximum of each value by group."""
    return records.groupBy(*by).agg(*(f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max))), F.count(F.lit(1)).alias("n"))


def ordered(records: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The mean of a value by group, and each group's place from the least on, ties by name: the order of bars in a chart. One row a group is sorted."""
    means = records.groupBy(*by).agg(F.avg(value).alias(f"{value}_mean"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(f"{value}_mean", *by)))
