"""Neighbours against brute force: recall where a graph doesn't see every node, exponents of all sizes, odd rows."""

import math

import numpy as np

from llm import neighbours


def brute(rows, queries, k=10):
    out = {}
    for q, v in queries:
        near = sorted((math.dist(v, w), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = near[:k]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def test_recall_of_large_shards(spark):
    """Three shards of over 4000 rows in 64 dimensions, more than ten times what a search keeps in sight."""
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((400, 64))[rng.integers(0, 400, 13_000)] + 0.7 * rng.standard_normal((13_000, 64))).astype(np.float32).astype(float)
    t = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = results(neighbours.search(spark, t, t.where("vec_id % 100 = 0"), shard_rows=4500))
    hit, exact = 0, 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = set(np.argsort(d, kind="stable")[:10].tolist())
        hit += len(want & {i for _, i in found})
        exact += all(abs(d[i] - s) < 1e-12 for s, i in found)
    assert len(got) == exact == 130 and hit >= 0.9 * 1300


def test_recall_can_fall_short():
    """One graph, searched with hardly any nodes in sight: the measure above is able to fail."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((5000, 64))
    g = neighbours.build(np.arange(5000), x)
    recall = {}
    for ef in (11, neighbours.SEARCH):
        hit = 0
        for q in range(0, 5000, 100):
            got = {i for _, _, i in neighbours._found(g, np.array([q]), x[q : q + 1], 10, ef)}
            d = ((x - x[q]) ** 2).sum(1)
            d[q] = np.inf
            hit += len(got & set(np.argsort(d)[:10].tolist()))
        recall[ef] = hit / 500
    assert recall[11] < 0.9 <= recall[neighbours.SEARCH]


def test_exponents(spark):
    """Ordinary vectors beside components of 1e-200 to 1e300: each found at its exact distance, ties by id."""
    rng = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((300, 6)).tolist())]
    for k, size in enumerate((1e60, 1e60, 1e200, -1e200, 1e300, 3e-7, 1e-60, 1e-200, 1e6, -1e25)):
        for j in range(4):
            v = rng.standard_normal(6)
            v[j % 6] = 1.0 + j / 8
            rows.append((1000 + 10 * k + j, (v * size).tolist() if j % 2 else [size, *rng.standard_normal(5).tolist()]))
    rows += [(2000, [1e60, 0.0, 0.0, 0.0, 0.0, 0.0]), (2050, [1.7e308, 0.0, 0.0, 0.0, 0.0, 1.0]), (2100, [5e-324] * 6)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [r for r in rows if r[0] >= 1000 or r[0] % 50 == 0]
    got = results(neighbours.search(spark, t, t.where("vec_id >= 1000 or vec_id % 50 = 0"), shard_rows=100))
    want = brute(rows, asked)
    assert set(got) == set(want)
    for q in want:
        assert len(got[q]) == 10
        for (s, i), (w, j) in zip(got[q], want[q]):
            assert i == j or math.isclose(s, w, rel_tol=1e-14), (q, s, i, w, j)
            assert math.isclose(s, w, rel_tol=1e-12) or s == w
    far = next(q for q, *_ in asked if q == 1020)
    assert [i for _, i in got[far]][-3:] == [i for _, i in want[far]][-3:]


def test_odd_rows(spark):
    """Null ids, repeated ids and rows, clashing columns, vectors of other lengths, an empty table."""
    rows = [(i, [float(i % 7), float(i // 7), 1.0]) for i in range(60)] + [(None, [0.0, 0.0, 1.0]), (3, [9.0, 9.0, 9.0]), (5, [5.0, 0.0, 1.0]), (5, [5.0, 0.0, 1.0]), (100, [1.0, 2.0]), (200, [1.0, 2.5]), (300, []), (400, None), (500, [math.inf, 0.0, 0.0])]
    t = spark.createDataFrame([(*r, "s", 1, "q") for r in rows], "vec_id long, embedding array<double>, shard string, rank int, query_id string")
    got = results(neighbours.search(spark, t, t.where("vec_id % 5 = 0"), shard_rows=20))
    whole = [(i, v) for i, v in rows if i is not None and v and all(map(math.isfinite, v))]
    for q, v in {q: v for q, v in whole if q % 5 == 0}.items():
        near = sorted((math.dist(v, w), i) for i, w in whole if i != q and len(w) == len(v))[:10]
        assert got[q] == near, q
    assert got[100] == [(0.5, 200)] and 300 not in got and 500 not in got
    assert neighbours.search(spark, t.limit(0), t.limit(0)).count() == 0
