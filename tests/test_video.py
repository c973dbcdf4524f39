"""Selection kernels against plain versions that work out everything anew at each step, and on hand-made videos."""

import numpy as np
import pytest

from keyframe.operators import search as S
from keyframe.operators import video as V


def clip(seed, n=80, scenes=6):
    """Scenes of like frames, some of them blurred."""
    rng = np.random.default_rng(seed)
    scene = np.sort(rng.integers(0, scenes, n))
    base = rng.random((scenes, 12))
    return V.Clip(base[scene] + 0.02 * rng.random((n, 12)), rng.integers(40, 200, n))


def r(c, a, b):
    return np.corrcoef(c.hist[a], c.hist[b])[0, 1]


def plain_split(c, start, end):
    length, half = end - start, (start + end) // 2
    if length <= 2:
        return half
    grid = list(range(start, end, max(1, length // min(length, 10)))) + [end]
    change = [1 - r(c, a, b) for a, b in zip(grid, grid[1:])]
    k = change.index(max(change))
    a, b = grid[k], grid[k + 1]
    at = b
    if b - a > 2:
        fine = sorted({*range(a, b + 1, max(1, (b - a) // 20)), b})
        while fine and r(c, fine[-1], b) >= 0.99:
            at = fine.pop()
    if c.sharp[at] < 100:
        window = [i for i in range(at - max(3, (b - a) // 10), at + max(3, (b - a) // 10) + 1) if start < i < end]
        top = max([c.sharp[i] for i in window], default=0)
        if top > c.sharp[at]:
            at = next(i for i in window if c.sharp[i] == top)
    return at if start + int(length * 0.15) <= at <= start + int(length * 0.85) else half


@pytest.mark.parametrize("seed", range(12))
def test_split_point(seed):
    c = clip(seed)
    for start in range(0, 60, 7):
        for end in range(start + 1, 80, 11):
            assert V.split_point(c, (start, end)) == plain_split(c, start, end)


def plain_capped(c, limit=16, start=4):
    """One split a step, always of the segment that the forced rule or, without one, its length names."""
    sample = [int(i * (c.n - 1) / (start - 1)) for i in range(start)]
    segs, stalled, left = list(zip(sample, sample[1:])), 0, limit - start + 10
    same = lambda f: max(r(c, f, k) for k in sample) >= 0.985
    while left and len(sample) < limit and stalled < 5 and any(e - s > 1 for s, e in segs):
        left -= 1
        gaps = [(b - a, -a) for a, b in zip(sample, sample[1:])]
        big = max(gaps)
        pick = None
        if len(sample) >= start + 2 and big[0] > 3 * np.mean([g for g, _ in gaps]) and (-big[1], -big[1] + big[0]) in segs:
            pick = segs.index((-big[1], -big[1] + big[0]))
        if pick is None or segs[pick][1] - segs[pick][0] <= 1:
            size = [e - s for s, e in segs]
            pick = size.index(max(size))
        s, e = segs[pick]
        at = plain_split(c, s, e)
        at = at if s < at < e else (s + e) // 2
        half = (s + e) // 2
        if same(at) and half != at and half not in sample and not same(half):
            at = half
        if same(at):
            segs[pick : pick + 1] = [(s, at), (at, e)]
            stalled += 1
        else:
            sample = sorted({*sample, at})
            segs, stalled = list(zip(sample, sample[1:])), 0
    while len(sample) < limit:
        size, where = max(((b - a, -a) for a, b in zip(sample, sample[1:])))
        if size <= 1:
            break
        s, e = -where, -where + size
        at = plain_split(c, s, e)
        at = at if s < at < e else (s + e) // 2
        sample = sorted({*sample, (s + e) // 2 if same(at) else at})
    return sample


@pytest.mark.parametrize("seed", range(8))
def test_capped_search(seed):
    c = clip(seed, 120, 20)
    got = V.capped_search(c, lambda sample, segments, able: [V.longest(segments)])
    assert got["sample"] == plain_capped(c)
    assert len(got["sample"]) == 16


def test_capped_edges():
    c = clip(1, 9)
    assert V.capped_search(c, None)["sample"] == list(range(9))
    still = V.Clip(np.ones((100, 4)), np.full(100, 200))
    got = V.capped_search(still, lambda *a: [])
    assert (got["reason"], got["steps"], len(got["sample"])) == ("stalled", 0, 16)


@pytest.mark.parametrize("seed", range(6))
def test_guided_search(seed):
    c = clip(seed, 200, 30)
    bad = lambda i: 20 < i < 180 and i % 9 != 4  # noqa: E731  relevant frames
    got = V.guided_search(c, lambda sample, segments, able: able[:3], bad, lambda s: 1, 2.0)
    assert got["low"] == next(i for i in range(0, 200, 4) if bad(i)) and got["high"] == next(i for i in range(199, 0, -4) if bad(i))
    assert got["sample"] == sorted(set(got["sample"])) and len(got["sample"]) <= 11
    assert all(got["low"] <= f <= got["high"] for f in got["sample"])
    sure = V.guided_search(c, lambda sample, segments, able: able[:1], lambda i: True, lambda s: 3, 2.0)
    assert 8 <= len(sure["sample"]) <= 11 and sure["trust"] in (0, 3)
    still = V.Clip(np.ones((60, 4)), np.full(60, 200))
    assert V.guided_search(still, lambda *a: [], lambda i: True, lambda s: 1, 2.0)["sample"] == V.stepped(0, 59, 20)


def test_bounds_and_replacement():
    assert V.content_bounds(lambda i: 10 <= i <= 50, 100, 6) == (12, 45)
    assert V.content_bounds(lambda i: True, 100, 6) == (0, 99)
    low, high = V.content_bounds(lambda i: False, 100, 6)
    assert low > 93 and high == 99
    assert V.replacement(lambda i: True, 30, [0, 60], (0, 99)) == 30
    assert V.replacement(lambda i: i in (25, 35), 30, [0, 60], (0, 99)) == 35
    assert V.replacement(lambda i: i == 25, 30, [0, 60], (0, 99)) == 25
    assert V.replacement(lambda i: i == 61, 30, [0, 60], (0, 99)) is None


def test_agent_search():
    got = V.agent_search(100, lambda s: 1, lambda s: [(0, 7), (9, 3)])
    assert got["sample"] == [0, 6, 7, 24, 49, 74, 99] or {0, 24, 49, 74, 99} <= set(got["sample"])
    assert got["steps"] == 3 and got["reason"] == "rounds"
    assert V.agent_search(100, lambda s: 3, None) == {"sample": [0, 24, 49, 74, 99], "steps": 1, "trust": 3, "reason": "sure"}
    assert V.agent_search(3, lambda s: 1, lambda s: [(0, -1)])["sample"] == [0, 1, 2]


def plain_ward(x, k):
    """Merge, again and again, the two groups whose union adds least to the squared distances from the means."""
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        cost = {}
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                a, b = x[groups[i]].mean(0), x[groups[j]].mean(0)
                n, m = len(groups[i]), len(groups[j])
                cost[i, j] = n * m / (n + m) * ((a - b) ** 2).sum()
        i, j = min(cost, key=cost.get)
        groups[i] += groups.pop(j)
    return sorted(sorted(g) for g in groups)


def test_ward():
    rng = np.random.default_rng(3)
    for _ in range(5):
        x = rng.random((14, 3))
        label = V.ward(x, 4)
        assert sorted(np.flatnonzero(label == c).tolist() for c in range(4)) == plain_ward(x, 4)


@pytest.mark.parametrize("k", [1, 2, 5, 14])
def test_ward_scales(k):
    """All cuts agree with plain merging; thousands of rows take seconds, and memory for the rows only."""
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(c, 0.3, (7, 4)) for c in rng.random((2, 4)) * 5])
    label = V.ward(x, k)
    assert sorted(np.flatnonzero(label == c).tolist() for c in range(k)) == plain_ward(x, k)
    same = np.repeat(rng.random((3, 4)), 5, axis=0)
    assert len(set(map(tuple, np.c_[V.ward(same, 3), np.repeat(range(3), 5)]))) == 3
    big = np.concatenate([rng.normal(c, 0.1, (1000, 8)) for c in range(5)])
    assert (V.ward(big, 5) == np.repeat(range(5), 1000)).all()


@pytest.mark.parametrize("seed", range(6))
def test_clusters_search_alike(seed):
    """What is worked out once for a video gives the frames of a search for each question."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.05, (25, 6)) for c in rng.random((5, 6)) * 3 + 1])
    for table in (x, np.floor(2 * x), x[:3], x[:1]):
        held = V.Clusters(table, seed)
        for q in range(5):
            look = lambda rows, q=q: [1 + (7 * r + q) % 3 if q < 3 else q - 2 for r in rows]
            assert held.search(look) == V.cluster_search(table, look, seed=seed)


def test_breadth_and_depth():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.05, (30, 6)) for c in rng.random((5, 6)) * 3 + 1])
    near, score, nodes, k = V.wide_enough(x, lambda rows: [3] * len(rows))
    assert k == 8 and nodes == sorted(nodes) and all(near[n] in score for n in nodes)
    assert V.wide_enough(x, lambda rows: [1] * len(rows))[3] == 32
    alone = V.deep_enough(x, near, dict.fromkeys(score, 1))
    assert len(alone) == len(np.unique(near)) and set(near[alone]) == set(near)
    deep = V.deep_enough(x, near, dict.fromkeys(score, 3))
    assert len(V.deep_enough(x, near, dict.fromkeys(score, 2))) <= 5 * len(score) and len(deep) > len(alone)
    assert len(V.cluster_search(x, lambda rows: [3] * len(rows))) == 16
    assert V.cluster_search(x[:1], None) == [0]


def test_kmeans_assigns_nearest():
    x = np.random.default_rng(1).normal(size=(60, 4))
    near, centres = V.cosine_kmeans(x, 6, seed=4, rounds=200, tolerance=1e-18)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    assert (near == np.argmax(unit(x) @ unit(centres).T, 1)).all()


@pytest.mark.parametrize("others,want", [("retain", [(0, 2), (2, 4), (4, 6), (6, 9)]), ("prune", [(2, 4), (4, 6)]), ("merge", [(0, 2), (2, 4), (4, 6), (6, 9)])])
def test_split_others(others, want):
    assert S.split_others([(0, 2), (2, 6), (6, 9)], [(2, 6)], others, 9) == want


def test_answered_search():
    v = np.arange(100.0)
    never = lambda s: (-1, 1, -1, 1)
    got = S.answered_search(v, S.STRATEGIES["bfs"], never, 20, 1, 3, "retain", 2)
    assert (got["answer"], got["at_step"]) == (-1, "final_direct_qa") and got["n_frames"] == 5 + 2 + 2 + 2
    late = lambda s: (2, 3, -1, 1) if len(s) >= 7 else (4, 1, -1, 1)
    assert S.answered_search(v, S.STRATEGIES["bfs"], late, 20, 1, 3, "retain", 2)["at_step"] == "2_s_qa"


def plain_tree(v, strategy, interval=20, beam=3, steps=4):
    """The caption search that keeps all segments, with sets of frames only: segments follow from the frames."""
    n, answer = len(v), S.spread_answer(v)
    now = set(range(0, n, interval))
    seen = set(now)

    def sure(frames):
        s, cs, r, cr = answer(sorted(frames))
        return (s, "s") if cs >= 3 else (r, "r") if cr >= 3 else None

    for step in range(1, steps + 1):
        if got := sure(now):
            return got[0], f"{step}_{got[1]}_qa", sorted(seen)
        for _ in range(1 if strategy == "bfs" else beam):
            able = [(a, b) for a, b in zip(sorted(now), sorted(now)[1:]) if b - a > 1]
            high = lambda s: max(v[s[0] + 1 : s[1]])
            jump = lambda s: abs(v[s[1]] - v[s[0]])
            both = lambda s: high(s) + jump(s)
            worth = {"bfs": lambda s: s[1] - s[0], "gbfs": high, "dijkstra": jump, "a_star": both, "adaptive": both}[strategy]
            mean = float(np.mean([b - a for a, b in able])) if able else 0.0
            wide = lambda s: -((s[1] - s[0]) / mean > 1.5) + ((s[1] - s[0]) / mean < 0.5) if strategy == "adaptive" else 0
            able.sort(key=lambda s: (wide(s), -worth(s), s[0]))
            now |= {(a + b) // 2 for a, b in able[: beam if strategy == "bfs" else 1]}
        seen |= now
    if got := sure(seen):
        return got[0], f"post_{got[1]}_qa", sorted(seen)
    return answer(sorted(seen))[0], "final_direct_qa", sorted(seen)


@pytest.mark.parametrize("strategy", list(S.STRATEGIES))
def test_tree_search(spark, strategy):
    rng = np.random.default_rng(8)
    videos = {k: rng.integers(0, 1000, int(rng.integers(30, 140))) for k in range(12)}
    t = spark.createDataFrame([(k, i, int(x)) for k, v in videos.items() for i, x in enumerate(v)], "video long, idx int, v int")
    got = {r.video: (r.answer, r.at_step, r.frames) for r in S.tree_search(t, strategy).collect()}
    assert got == {k: plain_tree(v.astype(float), strategy) for k, v in videos.items()}
    assert len({g[1] for g in got.values()}) > 1


def test_ssim():
    from keyframe.operators.similarity import ssim

    rng = np.random.default_rng(1)
    a, b = rng.random((9, 9)), rng.random((9, 9))
    span = max(a.max(), b.max()) - min(a.min(), b.min())
    total = []
    for i in range(3):
        for j in range(3):
            x, y = a[i : i + 7, j : j + 7].ravel(), b[i : i + 7, j : j + 7].ravel()
            cov = np.cov(x, y)
            total.append((2 * x.mean() * y.mean() + (0.01 * span) ** 2) * (2 * cov[0, 1] + (0.03 * span) ** 2) / ((x.mean() ** 2 + y.mean() ** 2 + (0.01 * span) ** 2) * (cov[0, 0] + cov[1, 1] + (0.03 * span) ** 2)))
    assert abs(ssim(a, b) - np.mean(total)) < 1e-12 and abs(ssim(a, a) - 1) < 1e-12


def test_small_parts_need_no_merges(monkeypatch):
    """No more rows than clusters are clusters of their own: no merges are worked out for them."""
    monkeypatch.setattr(V, "ward_merges", lambda x: 1 / 0)
    x = np.random.default_rng(1).random((4, 3))
    assert V.ward(x, 4).tolist() == [0, 1, 2, 3] and V.ward(x[:2], 4).tolist() == [0, 1]
    assert V.deep_enough(x, np.zeros(4, int), {0: 2}) == [0, 1, 2, 3]


def test_segments_split_once(monkeypatch):
    """What the questions of a video share is worked out once: a segment's split point."""
    rng = np.random.default_rng(3)
    clip, asked = V.Clip(rng.random((80, 5)), rng.integers(40, 200, 80)), []

    def split(clip, segment):
        asked.append(segment)
        return V.split_point(clip, segment)

    first = V.capped_search(clip, lambda sample, segments, able: able[:1], split=split)
    assert V.capped_search(clip, lambda sample, segments, able: able[:1], split=split) == first
    assert len(asked) == len(set(asked)) > 5
