"""K-means over a table against a plain loop: drawing, stopping, empty clusters, going on after a break."""

import hashlib

import numpy as np
import pytest

from keyframe.operators import clusters as K
from keyframe.streaming import shared


def plain(rows, k, seed, rounds, tolerance):
    draw = lambda words, n: [np.array(v) for _, _, v in sorted((hashlib.md5(f"{words}:{i}".encode()).hexdigest(), i, v) for i, v in rows)[:n]]
    centres = draw(str(seed), k)
    x, n, moved, emptied = np.array([v for _, v in rows]), 0, np.inf, 0
    near = None
    while n < rounds and moved**2 >= tolerance:
        cos = np.array([[v @ c / (np.linalg.norm(v) * np.linalg.norm(c)) for c in centres] for v in x])
        near = np.array([min(range(len(centres)), key=lambda j: (round(-r[j], 9), j)) for r in cos])
        new = []
        for j in range(len(centres)):
            emptied += not (near == j).any()
            new.append(x[near == j].mean(0) if (near == j).any() else draw(f"{seed}:{n}:{j}", 1)[0])
        moved = sum(np.linalg.norm(a - b) for a, b in zip(new, centres))
        centres, n = new, n + 1
    return {i: int(c) for (i, _), c in zip(rows, near)}, n, emptied


def table(spark, rows):
    return spark.createDataFrame([(i, v, "c") for i, v in rows], "id long, vec array<double>, cluster string").repartition(5)


def test_lloyd_stops(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, (c + rng.normal(0, 0.1, 5)).tolist()) for i, c in enumerate(np.repeat(rng.normal(0, 2, (6, 5)), 40, axis=0))]
    want, n, _ = plain(rows, 6, 4, 20, 1e-4)
    got, rounds = K.lloyd(spark, table(spark, rows), "id", "vec", 6, f"file://{tmp_path}/a", 4)
    assert {r.id: r.cluster for r in got.collect()} == want and rounds == n and 1 < n < 20
    two, bound = K.lloyd(spark, table(spark, rows), "id", "vec", 6, f"file://{tmp_path}/b", 4, rounds=2, tolerance=0.0)
    assert {r.id: r.cluster for r in two.collect()} == plain(rows, 6, 4, 2, 0.0)[0] and bound == 2


def test_lloyd_empty_cluster(spark, tmp_path):
    """Rows of few directions: drawn centres coincide, and what stays empty takes a drawn row."""
    rows = [(i, [float(1 + i % 2), float(i % 3 == 0), 1.0]) for i in range(40)]
    want, n, emptied = plain(rows, 8, 2, 6, 1e-4)
    got, rounds = K.lloyd(spark, table(spark, rows), "id", "vec", 8, f"file://{tmp_path}/a", 2, rounds=6)
    assert {r.id: r.cluster for r in got.collect()} == want and rounds == n and emptied > 0


def test_lloyd_goes_on(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(200, 4)).tolist())]
    real, calls = K._sums_map, []

    def breaks(centres):
        calls.append(centres)
        if len(calls) == 3:
            raise OSError("lost")
        return real(centres)

    store = f"file://{tmp_path}/a"
    monkeypatch.setattr(K, "_sums_map", breaks)
    with pytest.raises(OSError, match="lost"):
        K.lloyd(spark, table(spark, rows), "id", "vec", 5, store, 1, rounds=6, tolerance=0.0)
    assert shared.names(spark, store) == ["round-0000", "round-0001", "round-0002"]
    got, n = K.lloyd(spark, table(spark, rows), "id", "vec", 5, store, 1, rounds=6, tolerance=0.0)
    assert {r.id: r.cluster for r in got.collect()} == plain(rows, 5, 1, 6, 0.0)[0] and n == 6 and len(calls) == 7


def test_lloyd_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [1.0]), (6, [None, 1.0]), (None, [1.0, 1.0])]
    got = sorted(((r.id, r.cluster) for r in K.lloyd(spark, table(spark, rows), "id", "vec", 9, f"file://{tmp_path}/a")[0].collect()), key=str)
    assert len(got) == 8 and all((c is None) == (i in (3, 4, 5, 6)) for i, c in got)
    assert K.lloyd(spark, table(spark, []), "id", "vec", 2, f"file://{tmp_path}/b")[0].count() == 0
