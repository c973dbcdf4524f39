"""Cosine k-means over a whole table: rounds of one pass each, whose state is written."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyframe.streaming import shared


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of greatest cosine for each row, the first of equals (to nine decimals)."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    return np.argmin(np.round(-(unit(x) @ unit(centres).T), 9), 1)


def _sums_map(centres: np.ndarray):
    """Number and sum of each cluster's rows in a task."""

    def run(batches):
        count, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape)
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                near = nearest(x, centres)
                count += np.bincount(near, minlength=len(centres))
                np.add.at(total, near, x)
        at = np.flatnonzero(count)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at]), pa.array(total[at].tolist(), pa.list_(pa.float64()))], ["cluster", "n", "total"])

    return run


def _drawn(rows: DataFrame, key: str, words: str, n: int) -> list:
    """The n rows of least digest of ``words`` and key: a draw that doesn't depend on how the table is split."""
    mixed = F.md5(F.concat(F.lit(f"{words}:"), F.col(key).cast("string")))
    return [r.vec for r in rows.select("vec", mixed.alias("m"), F.col(key).alias("k")).orderBy("m", "k").limit(n).collect()]


def lloyd(spark: SparkSession, frames: DataFrame, key: str, vec: str, k: int, store: str, seed: int = 0, rounds: int = 20, tolerance: float = 1e-4) -> tuple[DataFrame, int]:
    """((key, cluster) of every row, rounds run): the start is k drawn rows; in each round rows go to their nearest centre, and
    centres to the mean of their rows; an empty cluster takes a drawn row. Stops when the centres' steps, summed and
    squared, are under ``tolerance``, or after ``rounds``.

    A round is one pass: tasks send a number and a sum for each cluster, which are added by cluster and component; the
    driver holds k centres. They are written after each round to ``store``, where a run that broke off goes on. Rows whose
    vector is null, empty, of another length than most or holds a null have a null cluster; keys may repeat. Draws go by
    the key as text. With fewer rows than k there are as many clusters as rows, without any none."""
    whole = frames.select(F.col(key), F.col(vec).cast("array<double>").alias("vec"))
    sizes = whole.where(F.col("vec").isNotNull()).groupBy(F.size("vec").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    good = F.coalesce((F.size("vec") == (sizes.d if sizes else 0)) & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull()), F.lit(False))
    rows = whole.where(good)
    done = [n for n in shared.names(spark, store) if shared.written(spark, f"{store}/{n}")]

    def saved(n: int, centres: np.ndarray, moved: float) -> None:
        table = [(i, c, moved) for i, c in enumerate(centres.tolist())]
        spark.createDataFrame(table, "cluster int, centre array<double>, moved double").coalesce(1).write.mode("overwrite").parquet(f"{store}/round-{n:04d}")

    def read(n: int) -> tuple[np.ndarray, float | None]:
        got = spark.read.parquet(f"{store}/round-{n:04d}").orderBy("cluster").collect()  # k rows
        return np.array([r.centre for r in got]), got[0].moved if got else None

    if not done:
        saved(0, np.array(_drawn(rows, key, str(seed), k)), float("inf"))
    n = max(0, len(done) - 1)
    centres, moved = read(n)
    while len(centres) and n < rounds and moved**2 >= tolerance:
        sums = rows.select("vec").mapInArrow(_sums_map(centres), "cluster int, n long, total array<double>")
        parts = sums.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        new = np.full(centres.shape, np.nan)
        for r in parts.collect():  # k times the vectors' length
            new[r.cluster, r.i] = r.x / r.n
        empty = [c for c in range(len(centres)) if np.isnan(new[c, 0])]
        for c in empty:
            new[c] = _drawn(rows, key, f"{seed}:{n}:{c}", 1)[0]
        moved = float(np.sqrt(((new - centres) ** 2).sum(1)).sum())
        n += 1
        saved(n, new, moved)
        centres = new
    last = read(max(0, n - 1))[0]  # the centres that the rows of the last round went to

    @F.arrow_udf("int")
    def cluster(v: pa.Array) -> pa.Array:
        return pa.array(nearest(_matrix(v), last).astype(np.int32))

    near = rows.select(key, cluster("vec").alias("cluster")) if len(last) else rows.select(key, F.lit(None).cast("int").alias("cluster"))
    return near.unionByName(whole.where(~good).select(key, F.lit(None).cast("int").alias("cluster"))), n
