"""Joins on order against plain loops, and the rows that their plans make."""

import numpy as np
from pyspark.sql import functions as F

from keyframe.operators import joins as J


def test_points_in_intervals(spark):
    rng = np.random.default_rng(5)
    points = [(int(v), int(a), k) for k, (v, a) in enumerate(zip(rng.integers(0, 4, 600), rng.integers(-300, 3000, 600)))] + [(None, 5, -1), (1, None, -2)]
    spans = [(int(v), int(s), int(s + n), k) for k, (v, s, n) in enumerate(zip(rng.integers(0, 5, 80), rng.integers(-400, 2500, 80), 2 ** rng.integers(0, 11, 80) + rng.integers(-1, 9, 80)))]
    spans += [(1, 5, 5, 900), (1, 9, 3, 901), (None, 0, 10, 902), (2, 7, None, 903), (3, 10, 20, 904), (3, 10, 20, 904)]
    got = J.points_in_intervals(spark.createDataFrame(points, "video int, at int, p int"), spark.createDataFrame(spans, "video int, start int, end int, s int"), "video", "at")
    want = sorted((p, s) for v, a, p in points for w, lo, hi, s in spans if v is not None and v == w and a is not None and hi is not None and lo <= a < hi)
    assert sorted((r.p, r.s) for r in got.collect()) == want and len(want) > 500
    assert J.points_in_intervals(spark.createDataFrame(points, "video int, at int, p int"), spark.createDataFrame([], "video int, start int, end int, s int"), "video", "at").count() == 0


def test_points_in_intervals_hot(spark):
    """One long video cut into many segments: what meets is a small multiple of what is wanted."""
    n = 200_000
    f = spark.range(n).select(F.lit(1).alias("video"), F.col("id").alias("idx"))
    cut = spark.range(0, n, 40).select(F.lit(1).alias("video"), F.col("id").alias("start"), (F.col("id") + 40).alias("end"))
    met = J.points_in_intervals(f, cut, "video", "idx")
    assert met.count() == n
    assert "CartesianProduct" not in met._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in met._jdf.queryExecution().toString()
    pairs = cut.withColumn("b", F.explode(F.sequence(F.shiftright("start", 5), F.shiftright(F.col("end") - 1, 5)))).groupBy("b").count().agg(F.sum("count")).first()[0] * 32
    assert pairs < 3 * n


def test_nearest(spark):
    rng = np.random.default_rng(6)
    asked = [(int(v), int(a), k) for k, (v, a) in enumerate(zip(rng.integers(0, 5, 500), rng.integers(-900, 9000, 500)))] + [(9, 4, 1000)]
    ends = [(int(v), int(a)) for v, a in zip(rng.integers(0, 4, 60), rng.integers(-900, 9000, 60))] + [(1, None), (2, 100), (2, 100)]
    a, t = spark.createDataFrame(asked, "video int, at int, k int"), spark.createDataFrame(ends, "video int, to int")
    want = {k: min((x for w, x in ends if w == v and x is not None), key=lambda x: (abs(x - p), x), default=None) for v, p, k in asked}
    for width in (64, 1000, 1 << 20):
        got = J.nearest(a, t, "video", "at", "to", width).collect()
        assert {r.k: r.to for r in got} == want and len(got) == len(asked)
    assert J.nearest(a, t.limit(0), "video", "at", "to").where("to is not null").count() == 0
    hot = J.nearest(spark.range(100_000).select(F.lit(1).alias("v"), "id"), spark.range(0, 100_000, 1000).select(F.lit(1).alias("v"), F.col("id").alias("to")), "v", "id", "to")
    assert hot.where(F.col("to") != F.when(F.col("id") % 1000 <= 500, F.floor(F.col("id") / 1000)).otherwise(F.floor(F.col("id") / 1000) + 1) * 1000).where("id < 99000").count() == 0


def test_previous(spark):
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(3)) if i % 40 else None, int(a), f"r{i}") for i, a in enumerate(rng.choice(20_000, 400, replace=False) - 9000)]
    want = {}
    for p in (0, 1, 2, None):
        own = sorted(r for r in rows if r[0] == p and r[0] is p or r[0] == p)
        want |= {b[2]: a[2] if a else None for a, b in zip([None, *own], own)}
    t = spark.createDataFrame(rows, "p int, at int, name string")
    for width in (100, 5000, 1 << 20):
        got = J.previous(t, "p", "at", ["name"], width).collect()
        assert {r.name: r.prev and r.prev.name for r in got} == want and len(got) == 400


def test_leading(spark):
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(3)) if i % 30 else None, int(a)) for i, a in enumerate(rng.choice(9000, 500, replace=False) - 4000)]
    t = spark.createDataFrame(rows, "p int, at int")
    want = []
    for p in (0, 1, 2, None):
        own = sorted(r[1] for r in rows if r[0] == p)
        want += [(p, a) for a in own[: max(1, len(own) // 7)]]
    for width in (50, 3000, 1 << 20):
        got = J.leading(t, "p", "at", lambda n: F.greatest(F.lit(1), F.floor(n / 7)), width).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
