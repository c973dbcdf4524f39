"""Vector and histogram operators over frame features."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _packed(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spread_axes(rows: DataFrame, dim: int, n: int) -> np.ndarray:
    """The ``n`` axes along which unit vectors spread most, from sums over all rows: a square of ``dim`` numbers for each task,
    added up by place."""

    def run(batches):
        total, count = np.zeros((dim, dim + 1)), 0
        for batch in batches:
            u = _unit(_packed(batch.column("vec")))
            total += u.T @ np.c_[u, np.ones(len(u))]
            count += len(u)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["n", "total"])

    sums = rows.select("vec").mapInArrow(run, "n long, total array<double>").select("n", F.posexplode("total").alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    if not sums:
        return np.zeros((min(n, dim), dim))
    total = np.zeros(dim * (dim + 1))
    total[[r.i for r in sums]] = [r.x / sums[0].n for r in sums]
    total = total.reshape(dim, dim + 1)
    return np.linalg.eigh(total[:, :dim] - np.outer(total[:, dim], total[:, dim]))[1][:, ::-1][:, :n].T


def redundant(frames: DataFrame, part: str, key: str, vec: str, limit: float, block: int = 512, axes: int = 2) -> DataFrame:
    """(part, key) of the frames whose cosine with an earlier one of their part (by key) is ``limit`` or more.

    Equal vectors go by the earliest of them, before anything is compared. The others lie in cells on the axes along which
    the unit vectors spread most, as wide as two that are alike can be apart; frames of adjoining cells meet, as blocks of
    about ``block`` rows. A part or a cell of any size is dealt over as many tasks as it has pairs of blocks; nothing is
    left out. Vectors are of one length; those that are null or zero, and rows without a part, are like none; keys are whole numbers, once in a part."""
    v = F.col(vec).cast("array<double>")
    rows = frames.select(F.col(part).alias("part_"), F.col(key).cast("long").alias("key_"), v.alias("vec")).where(F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    first = rows.groupBy("part_", "vec").agg(F.min("key_").alias("key_"))
    copies = rows.join(first.withColumnRenamed("key_", "least_"), ["part_", "vec"]).where("key_ > least_").select("part_", "key_")
    one = rows.select(F.size("vec").alias("d")).first()
    if one is None:
        return rows.select(F.col("part_").alias(part), F.col("key_").cast(frames.schema[key].dataType).alias(key))
    width, along = max(0.0, 2 - 2 * limit) ** 0.5 + 1e-7, _spread_axes(rows, one.d, axes)
    names = [f"c{i}" for i in range(len(along))]

    def place(batches):
        for batch in batches:
            u = _unit(_packed(batch.column("vec")))
            cell = np.floor(u @ along.T / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("part_"), batch.column("key_"), pa.array([r.tobytes() for r in u], pa.binary()), *(pa.array(cell[:, i]) for i in range(len(along)))], ["part_", "key_", "unit", *names])

    kind = frames.schema[part].dataType.simpleString()
    placed = first.select("part_", "key_", "vec").mapInArrow(place, f"part_ {kind}, key_ long, unit binary, " + ", ".join(f"{n} int" for n in names))
    size = placed.groupBy("part_", *names).agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = placed.join(size, ["part_", *names]).withColumn("block_", F.pmod(F.xxhash64("key_"), F.col("blocks")))
    blocks = dealt.groupBy("part_", *names, "block_").agg(F.collect_list(F.struct("key_", "unit")).alias("rows_"), F.min("key_").alias("low_"), F.max("key_").alias("high_"))
    left = blocks
    for n in names:
        left = left.withColumn(n, F.explode(F.array(*(F.col(n) + step for step in (-1, 0, 1)))))
    right = blocks.select("part_", *names, F.col("rows_").alias("others_"), F.col("low_").alias("from_"))
    met = left.join(right, ["part_", *names]).where("from_ < high_").select("part_", "rows_", "others_")

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (keys, x), (others, y) = (_block(batch.column(c)[i].values) for c in ("rows_", "others_"))
                hit = keys[((x @ y.T >= limit) & (others[None] < keys[:, None])).any(1)]
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("part_")[i], len(hit)), pa.array(hit)], ["part_", "key_"])

    found = met.mapInArrow(compare, f"part_ {kind}, key_ long").unionByName(copies).distinct()
    return found.select(F.col("part_").alias(part), F.col("key_").cast(frames.schema[key].dataType).alias(key))


def _block(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    return rows.field("key_").to_numpy(), np.stack([np.frombuffer(b, float) for b in rows.field("unit").to_pylist()])


def components_of(frames: DataFrame, vec: str) -> DataFrame:
    return frames.select("*", F.posexplode(vec).alias("i", "v"))


def centroids(frames: DataFrame, part: str, vec: str) -> DataFrame:
    """(part, i, v): mean vectors, a row for each component."""
    return components_of(frames.select(part, vec), vec).groupBy(part, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))


def as_vectors(long: DataFrame, part: str) -> DataFrame:
    return long.groupBy(part).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("c"))


def medoids(frames: DataFrame, part: str, key: str, vec: str) -> DataFrame:
    """The row nearest to its part's centroid (cosine), first of equals."""
    c = as_vectors(centroids(frames, part, vec), part)
    d = frames.join(c, part).select(part, key, F.round(1 - cosine(F.col(vec), F.col("c")), 9).alias("d"))
    return d.groupBy(part).agg(F.min(F.struct("d", key)).alias("m")).select(part, F.col(f"m.{key}").alias(key))


def nearest_to_centre(frames: DataFrame, part: str, key: str, vec: str) -> DataFrame:
    """The row nearest to its part's centroid (Euclidean), first of equals."""
    c = as_vectors(centroids(frames, part, vec), part)
    apart = F.aggregate(F.zip_with(F.col(vec), F.col("c"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return frames.join(c, part).select(part, key, F.round(apart, 9).alias("d")).groupBy(part).agg(F.min(F.struct("d", key)).alias("m")).select(part, F.col(f"m.{key}").alias(key))


def pearson(a: Column, b: Column) -> Column:
    """Pearson's r of two arrays of equal length; null where one is even."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    away = lambda v: F.transform(v, lambda x: x - mean(v))
    return cosine(away(a), away(b))


def whole_correlation(a: str, b: str) -> Column:
    """Pearson's r of two columns of whole numbers, as an aggregate; 0 where one is even. Sums are exact, so the result doesn't
    depend on the order of rows."""
    n, x, y = F.count("*").cast("decimal(18,0)"), F.col(a).cast("decimal(14,0)"), F.col(b).cast("decimal(14,0)")
    spread = lambda p, q: (n * F.sum(p * q) - F.sum(p) * F.sum(q)).cast("double")
    both, one, other = spread(x, y), spread(x, x), spread(y, y)
    return F.when((both == 0) | (one == 0) | (other == 0), 0.0).otherwise(both / (F.sqrt(one) * F.sqrt(other)))


def assign(frames: DataFrame, seeds: DataFrame, key: str, vec: str) -> DataFrame:
    """Nearest seed by cosine, smaller cluster of equals. ``seeds(cluster, c)`` is a fixed small set by construction:
    it travels as one row of arrays."""
    one = seeds.agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("seeds"))
    near = F.transform("seeds", lambda s: F.struct(F.round(-cosine(F.col(vec), s["c"]), 9).alias("d"), s["cluster"].alias("cluster")))
    return frames.crossJoin(F.broadcast(one)).select(key, F.array_min(near)["cluster"].alias("cluster"))


def histogram(frames: DataFrame, part: str, value: Column, bins: int) -> DataFrame:
    """Counts by bin and their share of the vector's length."""
    h = frames.select(part, value.alias("bin")).groupBy(part, "bin").agg(F.count("*").alias("n"))
    total = F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(part))
    return h.withColumn("norm", F.round(F.col("n") / F.sqrt(total), 6))


def laplacian_variance(picture: Column, width: int) -> Column:
    """Variance of the Laplacian of a square picture given as one array; cells beyond the border mirror those inside."""
    n = width * width
    near = [(i + width if i < width else i - width, i - width if i >= n - width else i + width, i + 1 if i % width == 0 else i - 1, i - 1 if i % width == width - 1 else i + 1) for i in range(n)]
    around = F.array(*(F.array(*map(F.lit, x)) for x in near))
    value = F.zip_with(around, picture, lambda a, v: F.aggregate(a, F.lit(0.0), lambda s, j: s + F.get(picture, j)) - 4 * v)
    mean = F.aggregate(value, F.lit(0.0), lambda s, x: s + x) / n
    return F.aggregate(value, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n


def bounds(picture: Column, width: int, over: Column) -> Column:
    """struct(left_px, top_px, right_px, bottom_px) of the cells of a square picture over a value; (0, 0, 1, 1) without any."""
    cells = F.filter(F.transform(picture, lambda v, i: F.when(v > over, i)), lambda i: i.isNotNull())
    cols, rows = F.transform(cells, lambda i: i % width), F.transform(cells, lambda i: F.floor(i / width).cast("int"))
    low, high = (lambda a: F.coalesce(F.array_min(a), F.lit(0))), (lambda a: F.coalesce(F.array_max(a) + 1, F.lit(1)))
    return F.struct(low(cols).alias("left_px"), low(rows).alias("top_px"), high(cols).alias("right_px"), high(rows).alias("bottom_px"))


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """Mean structural similarity of two square pictures over all whole windows, evenly weighted; sample covariances, range
    by the two pictures' values."""
    span = max(float(max(a.max(), b.max()) - min(a.min(), b.min())), 1e-12)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    x, y = (np.lib.stride_tricks.sliding_window_view(v, (window, window)).reshape(-1, window * window) for v in (a, b))
    mx, my = x.mean(1), y.mean(1)
    vx, vy = x.var(1, ddof=1), y.var(1, ddof=1)
    both = ((x - mx[:, None]) * (y - my[:, None])).sum(1) / (window * window - 1)
    return float((((2 * mx * my + c1) * (2 * both + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())


def structural_similarity(a: Column, b: Column) -> Column:
    """``ssim`` of two square pictures given as arrays."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        side = lambda v: np.asarray(v, float).reshape(int(len(v) ** 0.5), -1)
        return pd.Series([ssim(side(p), side(q)) for p, q in zip(x, y)])

    return run(a, b)
