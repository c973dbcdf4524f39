"""Near-duplicate removal by bounds: the plain results, and how much is compared."""

import numpy as np
import pytest

from keyframe.operators import similarity as S
from keyframe.operators import video as V


def plain_kept(clip, limit):
    kept = []
    for i in range(clip.n):
        if not clip.repeats(i, kept, limit):
            kept.append(i)
    return kept


@pytest.mark.parametrize("limit", [0.985, 0.9, 0.5, -1.0])
def test_first_kept(limit):
    rng = np.random.default_rng(4)
    for n, scenes, d in ((300, 60, 12), (80, 3, 5), (40, 40, 1), (1, 1, 4), (60, 9, 2)):
        base = rng.random((scenes, d))
        hist = base[np.sort(rng.integers(0, scenes, n))] + 0.03 * rng.random((n, d))
        clip = V.Clip(hist, np.ones(n))
        assert V.first_kept(clip, limit)[0] == plain_kept(clip, limit)
    hist[[5, 9]] = 0.25  # even histograms are like anything
    clip = V.Clip(hist, np.ones(len(hist)))
    assert V.first_kept(clip, limit)[0] == plain_kept(clip, limit)
    still = V.Clip(np.ones((20, 4)), np.ones(20))
    assert V.first_kept(still, limit)[0] == [0]


def test_first_kept_compares_few():
    rng = np.random.default_rng(5)
    clip = V.Clip(rng.random((2000, 8)), np.ones(2000))
    kept, compared = V.first_kept(clip)
    assert kept == plain_kept(clip, V.REPEATS) and len(kept) > 1000
    assert compared < 0.15 * len(kept) * 2000 / 2


@pytest.mark.parametrize("limit", [0.95, 0.3])
def test_redundant(spark, limit):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 6))[rng.integers(0, 60, 500)] + 0.25 * rng.normal(size=(500, 6))
    x[40:60] = x[40]
    rows = [(int(i * 7 % 3) if i % 50 else None, 1000 - i, v.tolist()) for i, v in enumerate(x)] + [(1, 2000, [0.0] * 6), (1, 2001, None)]
    t = spark.createDataFrame(rows, "part int, id int, v array<double>").repartition(4)
    u = {(p, i): np.array(v) / np.linalg.norm(v) for p, i, v in rows if v and any(v)}
    want = {(p, i) for (p, i), a in u.items() if p is not None and any(q == p and j < i and a @ b >= limit for (q, j), b in u.items())}
    for block in (16, 512):
        got = S.redundant(t, "part", "id", "v", limit, block).where("part is not null").collect()
        assert {(r.part, r.id) for r in got} == want and len(got) == len(want) > 30
    assert S.redundant(t.limit(0), "part", "id", "v", limit).count() == 0
