"""Neighbourhood joins, frames over rasters, distances and nearest neighbours.

A neighbourhood is never a theta join: pixels fan out by a constant table of offsets and meet by equality on the shifted place, so Spark hashes both sides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["image_id", "y", "x"]


def box(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def _table(offsets: Sequence[tuple]) -> Column:
    """An offsets literal, (dy, dx[, weight]), as an array of structs."""
    rows = [F.struct(F.lit(o[0]).alias("dy"), F.lit(o[1]).alias("dx"), *([F.lit(float(o[2])).alias("w")] if len(o) > 2 else [])) for o in offsets]
    return F.array(*rows)


#: Height and width that images are declared to have. The pixels of it that an image does not hold, as those of the last one cut from a raster, are absent: windows are laid by the
#: declared size and count the pixels there are, borders lie at the declared size, and nothing stands in for an absent pixel. None: each image's own size.
Size = tuple[int, int] | None


def sized(df: DataFrame, h: str = "h", w: str = "w", size: Size = None) -> DataFrame:
    """Adds height and width of each image: the declared ones, else they are aggregated by image and joined back."""
    if size is not None:
        return df.withColumns({h: F.lit(size[0]), w: F.lit(size[1])})
    sizes = df.groupBy("image_id").agg((F.max("y") + 1).alias(h), (F.max("x") + 1).alias(w))
    return df.join(sizes, "image_id")


def neighbours(df: DataFrame, offsets: Sequence[tuple], values: Sequence[str], policy: str = "skip", size: Size = None) -> DataFrame:
    """Each pixel with each neighbour: image_id, y, x, ny, nx, dy, dx[, w], and the neighbour's values as n_<value>, besides df's columns.

    policy: skip (neighbours outside are left out), clamp (they are the nearest inside, repeats kept), interior (only pixels that have all neighbours).
    """
    reach = max(max(abs(o[0]), abs(o[1])) for o in offsets)
    own = sized(df, "_h", "_w", size) if policy in ("clamp", "interior") else df
    if policy == "interior":
        own = own.filter(F.col("y").between(reach, F.col("_h") - 1 - reach) & F.col("x").between(reach, F.col("_w") - 1 - reach))
    fan = own.withColumn("_o", F.explode(_table(offsets))).select("*", "_o.*").drop("_o")
    ny, nx = F.col("y") + F.col("dy"), F.col("x") + F.col("dx")
    if policy == "clamp":
        ny, nx = F.greatest(F.lit(0), F.least(F.col("_h") - 1, ny)), F.greatest(F.lit(0), F.least(F.col("_w") - 1, nx))
    fan = fan.withColumns({"ny": ny, "nx": nx})
    if policy in ("clamp", "interior"):
        fan = fan.drop("_h", "_w")
    other = df.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), *(F.col(v).alias(f"n_{v}") for v in values))
    return fan.join(other, ["image_id", "ny", "nx"])


def box_sum(df: DataFrame, radius: int = 3, mode: str = "same", column: str = "v", size: Size = None) -> DataFrame:
    """Sums over (2 radius + 1)^2 windows of dense images: two frames, one along each axis; a frame cut off at the border is zero padding.

    valid keeps the whole windows, full pads every image by 2 radius on each axis first. ValueError for a radius that is not positive.
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    if mode not in ("valid", "same", "full"):
        raise ValueError(f"unknown mode {mode}")
    rows = df.select(*KEY, column)
    if mode == "full":
        sizes = rows.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
        dense = sizes.select("image_id", F.explode(F.sequence(F.lit(0), F.col("h") + 2 * radius - 1)).alias("y"), "w")
        dense = dense.select("image_id", "y", F.explode(F.sequence(F.lit(0), F.col("w") + 2 * radius - 1)).alias("x"))
        moved = rows.select("image_id", (F.col("y") + radius).alias("y"), (F.col("x") + radius).alias("x"), column)
        rows = dense.join(moved, KEY, "left").withColumn(column, F.coalesce(column, F.lit(0.0)))
    down = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-radius, radius)
    across = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-radius, radius)
    out = rows.withColumn(column, F.sum(column).over(down)).withColumn(column, F.sum(column).over(across))
    if mode == "valid":
        inside = sized(out, size=size).filter(F.col("y").between(radius, F.col("h") - 1 - radius) & F.col("x").between(radius, F.col("w") - 1 - radius))
        out = inside.select("image_id", (F.col("y") - radius).alias("y"), (F.col("x") - radius).alias("x"), column)
    return out


def box_sum_prefix(df: DataFrame, radius: int, column: str = "v") -> DataFrame:
    """The same as box_sum(mode="same") by prefix sums, whose cost does not grow with the radius: a running sum each way, and differences of it at places 2 radius + 1 apart."""
    out = df.select(*KEY, column)
    for across, along in (("x", "y"), ("y", "x")):
        order = Window.partitionBy("image_id", across).orderBy(along)
        whole = Window.partitionBy("image_id", across)
        out = out.withColumn("_p", F.sum(column).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum(column).over(whole))
        upper = F.coalesce(F.lead("_p", radius).over(order), F.col("_t"))
        lower = F.coalesce(F.lag("_p", radius + 1).over(order), F.lit(0.0))
        out = out.withColumn(column, upper - lower).drop("_p", "_t")
    return out


def distance_transform(df: DataFrame, column: str = "mask") -> DataFrame:
    """d: the Euclidean distance of each pixel to the nearest with a zero (false) mask; infinity without any.

    Column frames give the vertical distance to the nearest zero above and below; a min-plus join along each row, from the columns that have one, does the rest.
    """
    zero = F.when(F.col(column).cast("int") == 0, F.col("y"))
    order = Window.partitionBy("image_id", "x").orderBy("y")
    above = F.last(zero, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(zero, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    inf = F.lit(float("inf"))
    g = F.least(F.coalesce((F.col("y") - above).cast("double"), inf), F.coalesce((below - F.col("y")).cast("double"), inf))
    rows = df.select(*KEY, g.alias("g"))
    other = rows.filter(F.col("g") < inf).select("image_id", "y", F.col("x").alias("x2"), F.col("g").alias("g2"))
    square = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + F.col("g2") * F.col("g2")
    near = rows.select(*KEY).join(other, ["image_id", "y"], "left").groupBy(*KEY).agg(F.min(square).alias("s"))
    return near.select(*KEY, F.coalesce(F.sqrt("s"), inf).alias("d"))


def gradient(df: DataFrame, column: str = "v") -> DataFrame:
    """gx, gy: half the difference of the neighbours each way, the border repeated."""
    x, y = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    at = lambda f, w: F.coalesce(f(column, 1).over(w), F.col(column))
    return df.select(*KEY, ((at(F.lead, x) - at(F.lag, x)) / 2).alias("gx"), ((at(F.lead, y) - at(F.lag, y)) / 2).alias("gy"))


def directional_difference(df: DataFrame, column: str = "v") -> DataFrame:
    """dx, dy: a pixel less its right and its lower neighbour, 0 at the border."""
    x, y = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    step = lambda w: F.col(column) - F.coalesce(F.lead(column, 1).over(w), F.col(column))
    return df.select(*KEY, step(x).alias("dx"), step(y).alias("dy"))


def resize(df: DataFrame, height: int, width: int, columns: Sequence[str], method: str = "nearest", size: Size = None) -> DataFrame:
    """nearest: the source pixel floor(i * n / m); box: the mean of the source pixels of a target pixel, with the shares in which they lie in it; bilinear, hamming,
    bicubic, lanczos: weighted by the method's filter along each axis in turn, widened when shrinking. Of images with absent pixels, box takes the mean of those there are, the
    filters take absent ones as 0, and target pixels without a source are absent.
    """
    if size is None:
        shape = df.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    else:
        shape = sized(df.select("image_id").distinct(), size=size)
    grid = df.sparkSession.range(height * width).select(F.expr(f"CAST(id DIV {width} AS INT)").alias("ty"), (F.col("id") % width).cast("int").alias("tx"))
    if method in ("nearest", "none"):
        target = shape.crossJoin(F.broadcast(grid))  # the grid has the fixed size asked for
        at = lambda t, n, m: F.least(F.expr(f"{t} * {n} DIV {m}").cast("int"), F.col(n) - 1)
        target = target.select("image_id", "ty", "tx", at("ty", "h", height).alias("y"), at("tx", "w", width).alias("x"))
        return target.join(df.select(*KEY, *columns), KEY).select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), *columns)
    sizes = [size] if size is not None else [(r.h, r.w) for r in shape.select("h", "w").distinct().collect()]
    if len(sizes) > 1:
        raise ValueError("images of one size are resized at a time")
    out = df.select(*KEY, *columns)
    whole = F.sum("_w") if method == "box" else F.lit(1.0)
    for axis, n, m in (("y", sizes[0][0] if sizes else 1, height), ("x", sizes[0][1] if sizes else 1, width)):
        weights = df.sparkSession.createDataFrame(axis_weights(n, m, method), f"{axis} int, _t int, _w double")
        other = "x" if axis == "y" else "y"
        joined = out.join(F.broadcast(weights), axis)  # at most a filter's width per target place
        out = joined.groupBy("image_id", other, F.col("_t").alias("_to")).agg(*((F.sum(F.col("_w") * F.col(c)) / whole).alias(c) for c in columns)).withColumnRenamed("_to", axis)
    return out.select(*KEY, *columns)


def axis_weights(n: int, m: int, method: str) -> list[tuple[int, int, float]]:
    """(source, target, weight) from n to m places, each target's weights with sum 1."""
    sinc = lambda x: np.sinc(x)
    support, f = {
        "box": (0.5, lambda x: ((x > -0.5) & (x <= 0.5)).astype(float)),
        "bilinear": (1.0, lambda x: np.maximum(1 - np.abs(x), 0)),
        "hamming": (1.0, lambda x: np.where(np.abs(x) < 1, sinc(x) * (0.54 + 0.46 * np.cos(np.pi * x)), 0)),
        "bicubic": (2.0, lambda x: np.where(np.abs(x) < 1, 1.5 * np.abs(x) ** 3 - 2.5 * x * x + 1, np.where(np.abs(x) < 2, -0.5 * np.abs(x) ** 3 + 2.5 * x * x - 4 * np.abs(x) + 2, 0))),
        "lanczos": (3.0, lambda x: np.where(np.abs(x) < 3, sinc(x) * sinc(x / 3), 0)),
    }[method]
    scale = n / m
    wide = max(scale, 1.0)
    out = []
    for t in range(m):
        centre = (t + 0.5) * scale
        lo, hi = max(0, int(centre - support * wide + 0.5)), min(n, int(centre + support * wide + 0.5))
        places = np.arange(lo, max(hi, lo + 1))
        w = f((places - centre + 0.5) / wide)
        if w.sum() == 0:
            w = np.ones(len(places))
        out += [(int(p), t, float(v)) for p, v in zip(places, w / w.sum(), strict=True) if v]
    return out


def _bundled(rows: DataFrame, parts: int, kind: str, most: int | None = None) -> DataFrame:
    """ids and fs: the rows (id, f) of each of parts as the bytes of two arrays. most: of equal vectors only so many are kept, those of the least ids."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, fs = [], []
        for batch in batches:
            ids.append(batch.column("id").to_numpy(zero_copy_only=False))
            fs.append(batch.column("f").flatten().to_numpy(zero_copy_only=False))
        n = sum(map(len, ids))
        if not n:
            return
        i = np.concatenate(ids)
        f = np.concatenate(fs).reshape(n, -1).astype(kind)
        order = np.argsort(i, kind="stable")
        i, f = i[order], f[order]
        if most is not None and f.shape[1]:
            same = np.unique(np.ascontiguousarray(f).view(f"V{f.itemsize * f.shape[1]}").ravel(), return_inverse=True)[1].ravel()
            by = np.argsort(same, kind="stable")
            first = np.searchsorted(same[by], same[by])
            kept = np.sort(by[np.arange(n) - first < most])
            i, f = i[kept], f[kept]
        yield pa.RecordBatch.from_pydict({"ids": pa.array([i.astype("<i8").tobytes()], pa.binary()), "fs": pa.array([f.tobytes()], pa.binary())})

    array = "array<float>" if kind == "<f4" else "array<double>"
    return rows.select(F.col("id").cast("long").alias("id"), F.col("f").cast(array).alias("f")).repartition(parts, "id").mapInArrow(bundle, "ids binary, fs binary")


def _nearest(y: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, rows: int = 1024, columns: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of y, ids, distances) of the k nearest rows of x, ties by id; some rows of y at a time.

    Single precision, one matrix product for a tile, tells which pairs can be among the nearest: those that exceed the k-th estimate by no more than twice the bound on the
    estimates' error. Their distances are then taken in double precision, so the result is exact.
    """
    k, dim = min(k, len(x)), x.shape[1]
    columns = max(columns, k)
    middle = x.mean(axis=0)
    b = x - middle
    square = (b * b).sum(axis=1)
    wide = np.hstack((-2 * b, square[:, None])).astype(np.float32).T  # [a, 1] times this is the squared distance less that of a
    far = np.sqrt(square.max())
    for begin in range(0, len(y), rows):
        some = y[begin : begin + rows]
        a = some - middle
        narrow = np.hstack((a, np.ones((len(a), 1)))).astype(np.float32)
        slack = 4 * (dim + 8) * 2.0**-24 * (2 * np.sqrt((a * a).sum(axis=1)) * far + far * far)
        best, limit, found = None, None, []
        for c in range(0, len(x), columns):
            s = narrow @ wide[:, c : c + columns]
            if best is None:
                best = np.partition(s, k - 1, axis=1)[:, :k].astype(np.float64)
                limit = best.max(axis=1) + slack
                r, q = np.nonzero(s <= limit[:, None])
                found.append((r, q, s[r, q]))
                continue
            r, q = np.nonzero(s <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None])  # compared in single precision, the limit rounded up
            if len(r):
                v = s[r, q]
                found.append((r, q + c, v))
                who, value = np.concatenate((np.repeat(np.arange(len(a)), k), r)), np.concatenate((best.ravel(), v))
                order = np.lexsort((value, who))
                who, value = who[order], value[order]
                best = value[np.searchsorted(who, np.arange(len(a)))[:, None] + np.arange(k)]
                limit = best.max(axis=1) + slack
        r, q, v = (np.concatenate(z) for z in zip(*found, strict=True))
        can = v <= limit[r]
        r, q = r[can], q[can]
        d = np.zeros(len(r))
        for c in range(dim):
            d += (some[r, c] - x[q, c]) ** 2
        order = np.lexsort((ids[q], d, r))
        r, q, d = r[order], q[order], d[order]
        near = np.arange(len(r)) - np.searchsorted(r, r) < k
        yield r[near] + begin, ids[q[near]], np.sqrt(d[near])


def knn(points: DataFrame, queries: DataFrame, k: int, broadcast_rows: int = 100_000, query_rows: int = 16_384) -> DataFrame:
    """qid, id, d, rank: the k nearest points (id, f) of each query (id, f) by Euclidean distance, ties by id; ValueError if there are fewer points.

    The points are cut into blocks of about broadcast_rows and the queries into parts of at most about query_rows, each a row of bytes; a task takes one block and one part, and each
    query keeps the best k of its blocks' k: what is shuffled is k rows per query and block. Queries are a stated set; the work is queries x points, as that of an exact search
    without an index, nearly all of it in matrix products.
    """
    n = points.count()
    if n < k:
        raise ValueError(f"{k} neighbours of {n} points")
    asked = n if queries is points else queries.count()
    blocks = -(-n // broadcast_rows)
    tasks = 3 * queries.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-asked // query_rows), min(-(-asked // 2048), -(-tasks // blocks)))  # small ones only as far as all cores need them
    kind = "<f4" if all(dict(t.dtypes)["f"] == "array<float>" for t in (points, queries)) else "<f8"
    some = _bundled(queries, parts, kind).withColumnsRenamed({"ids": "qids", "fs": "qs"})
    pairs = some.crossJoin(_bundled(points, blocks, kind, k))  # parts x blocks rows

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                qids, ids = np.frombuffer(row.qids, "<i8"), np.frombuffer(row.ids, "<i8")
                y, x = (np.frombuffer(v, kind).reshape(len(i), -1).astype(np.float64) for v, i in ((row.qs, qids), (row.fs, ids)))
                for r, near, d in _nearest(y, x, ids, k):
                    yield pd.DataFrame({"qid": qids[r], "id": near, "d": d})

    found = pairs.mapInPandas(best, "qid long, id long, d double")
    order = Window.partitionBy("qid").orderBy("d", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_of(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The k first rows of each group."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def bounding_boxes(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """dim, low and high of the points (f, an array) of each group: the box that holds them."""
    return points.select(*by, F.posexplode("f").alias("dim", "v")).groupBy(*by, "dim").agg(F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high"))
