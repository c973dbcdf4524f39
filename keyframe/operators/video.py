"""Kernels of keyframe selection over the features of one video. They are plain functions of a ``Clip`` and of callbacks
that stand for a model's choices, so that grouped pandas functions, tests and other clients use the same code.

A segment is (start, end), two frames of the sample that follow each other; a sample is a sorted list of frames.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Likeness from which a frame repeats another, and from which it is still the same picture; sharpness under
#: which a frame is blurred; gap by mean gap from which a sample is out of balance.
REPEATS, SAME, BLURRED, UNEVEN = 0.985, 0.99, 100.0, 3.0
#: Share of a segment at either end in which it isn't split.
FIRST_SPLIT, LAST_SPLIT = 0.15, 0.85

Segment = tuple[int, int]


class Clip:
    """Frames as rows of histograms and a sharpness each. Likeness is Pearson's r over the bins; even histograms count as
    like (their r is undefined)."""

    def __init__(self, hist, sharp):
        self.hist, self.sharp = np.asarray(hist, float), np.asarray(sharp, float)
        away = self.hist - self.hist.mean(1, keepdims=True)
        self.length = np.sqrt((away**2).sum(1))
        self.away, self.n = away, len(away)
        self.clusters = Clusters(self.hist)
        self.splits: dict[Callable, dict[Segment, int]] = {}  # by the function that splits, whatever is asked

    def like(self, a: int, b: int) -> float:
        both = self.length[a] * self.length[b]
        return float(self.away[a] @ self.away[b] / both) if both > 1e-12 else 1.0

    def repeats(self, frame: int, kept, limit: float = REPEATS) -> bool:
        return any(self.like(frame, k) >= limit for k in kept)


def first_kept(clip: Clip, limit: float = REPEATS) -> tuple[list[int], int]:
    """(frames that repeat none of those kept before them, pairs compared).

    Vectors of likeness ``limit`` or more are, at unit length, no farther apart than sqrt(2 - 2 limit), and no farther in any
    projection. So kept frames lie in cells of that width on the three axes along which the frames spread most, and a
    frame meets those of its own and the adjoining cells only. Nearly even histograms meet all, as their likeness isn't
    an angle."""
    even = clip.length < 1e-5
    unit = clip.away / np.maximum(clip.length, 1e-300)[:, None]
    unit[even] = 0
    axes = np.linalg.svd(unit - unit.mean(0), full_matrices=False)[2][:3] if clip.n else np.zeros((0, 1))
    width = math.sqrt(max(0.0, 2 - 2 * limit)) + 1e-7
    cell = np.floor(unit @ axes.T / width).astype(np.int64)
    around = list(np.ndindex(*(3,) * cell.shape[1]))
    cells: dict[tuple, list[int]] = {}
    kept: list[int] = []
    odd: list[int] = []
    compared = 0
    for i in range(clip.n):
        near = kept if even[i] else [*odd, *(k for step in around for k in cells.get(tuple(c + s - 1 for c, s in zip(cell[i].tolist(), step)), ()))]
        again = False
        for k in near:
            compared += 1
            if again := clip.like(i, k) >= limit:
                break
        if not again:
            kept.append(i)
            (odd if even[i] else cells.setdefault(tuple(cell[i].tolist()), [])).append(i)
    return kept, compared


def segments_of(sample: list[int]) -> list[Segment]:
    return list(zip(sample, sample[1:]))


def can_split(segment: Segment) -> bool:
    return segment[1] - segment[0] > 1


def middle(segment: Segment) -> int:
    return (segment[0] + segment[1]) // 2


def longest(segments: list[Segment], closed=()) -> int | None:
    """Number of the longest segment that can be split, the first of equals."""
    able = [i for i, s in enumerate(segments) if can_split(s) and s not in closed]
    return max(able, key=lambda i: (segments[i][1] - segments[i][0], -i), default=None)


def out_of_balance(sample: list[int]) -> Segment | None:
    """The largest gap, the first of equals, if it is over UNEVEN times the mean gap."""
    gaps = segments_of(sample)
    if not gaps:
        return None
    wide = max(gaps, key=lambda g: (g[1] - g[0], -g[0]))
    return wide if (wide[1] - wide[0]) * len(gaps) > UNEVEN * (sample[-1] - sample[0]) else None


def spaced(n: int, k: int) -> list[int]:
    """k whole indices from 0 to n - 1, fewer if n is smaller."""
    return list(range(n)) if n <= k else [i * (n - 1) // (k - 1) for i in range(k)]


def stepped(start: int, end: int, step: int) -> list[int]:
    """Every ``step``-th frame from start on, and the end."""
    at = list(range(start, end, max(1, step)))
    return at if at and at[-1] == end else [*at, end]


def split_point(clip: Clip, segment: Segment) -> int:
    """Where a segment is split: after its greatest change, once the picture stands still and is sharp.

    A coarse grid finds the pair of neighbours that differ most; a denser one, walked back from the pair's end, the first
    frame still the same as it; a blurred frame gives way to the sharpest one near it. Points near the ends of the segment
    give way to its middle."""
    start, end = segment
    size = end - start
    if size <= 2:
        return middle(segment)
    pairs = segments_of(stepped(start, end, size // min(size, 10)))
    a, b = max(pairs, key=lambda p: (1 - clip.like(*p), -p[0]))
    found = b
    if b - a > 2:
        for i in reversed(stepped(a, b, (b - a) // 20)):
            if clip.like(i, b) < SAME:
                break
            found = i
    if clip.sharp[found] < BLURRED:
        reach = max(3, (b - a) // 10)
        near = [i for i in range(found - reach, found + reach + 1) if start < i < end]
        best = max(near, key=lambda i: (clip.sharp[i], -i), default=found)
        found = best if clip.sharp[best] > clip.sharp[found] else found
    inside = start + int(size * FIRST_SPLIT) <= found <= start + int(size * LAST_SPLIT)
    return found if inside else middle(segment)


def inner_split(clip: Clip, segment: Segment, split=split_point) -> int:
    known = clip.splits.setdefault(split, {})
    if segment not in known:
        known[segment] = split(clip, segment)
    at = known[segment]
    return at if segment[0] < at < segment[1] else middle(segment)


def content_bounds(relevant: Callable[[int], bool], n: int, jump: int) -> Segment:
    """First and last frame of the content: from either end by jumps over irrelevant frames, never past each other."""
    head = 0
    while head <= n - 1 - jump and not relevant(head):
        head += jump
    tail = n - 1
    while tail >= head + jump and not relevant(tail):
        tail -= jump
    return head, tail


def replacement(relevant: Callable[[int], bool], frame: int, sample: list[int], bounds: Segment, tries: int = 5) -> int | None:
    """The frame itself if it is relevant; else the nearest relevant one on a grid between its neighbours in the sample,
    to the right first; None where there is none."""
    if relevant(frame):
        return frame
    left = max((s for s in sample if s < frame), default=bounds[0] - 1) + 1
    right = min((s for s in sample if s > frame), default=bounds[1] + 1) - 1
    step = max(5, (right - left) // 10)
    for away in range(step, tries * step + 1, step):
        for at in (frame + away, frame - away):
            if left <= at <= right and at not in sample and relevant(at):
                return at
    return None


#: A choice: (sample, segments, numbers of those that may be split) to the numbers of those to split, best first.
Pick = Callable[[list[int], list[Segment], list[int]], list[int]]


def capped_search(clip: Clip, pick: Pick, start: int = 4, limit: int = 16, split: Callable[[Clip, Segment], int] = split_point) -> dict:
    """Frames of a video, ``limit`` at most: one split a step, of the largest gap while the sample is out of balance, else
    of what ``pick`` chooses (or the longest segment). A new frame that repeats one of the sample gives way to the
    segment's middle; if that repeats one as well the segment is split without a frame. Stops at the limit, after five steps
    without a frame, or with nothing to split; then the largest gaps are filled."""
    n = clip.n
    if n <= limit:
        return {"sample": list(range(n)), "steps": 0, "forced": 0, "reason": "short"}
    sample = spaced(n, start)
    segments, stalled, steps, forced, reason = segments_of(sample), 0, 0, 0, "max_frames"
    for _ in range(limit - len(sample) + 10):
        able = [i for i, s in enumerate(segments) if can_split(s)]
        if len(sample) >= limit or stalled >= 5 or not able:
            reason = "max_frames" if len(sample) >= limit else "stalled" if stalled >= 5 else "nothing_to_split"
            break
        wide = out_of_balance(sample) if len(sample) >= start + 2 else None
        if wide in segments and can_split(wide):
            chosen, forced = segments.index(wide), forced + 1
        else:
            chosen = next((i for i in pick(sample, segments, able) if i in able), None)
            chosen = longest(segments) if chosen is None else chosen
        segment = segments[chosen]
        at = inner_split(clip, segment, split)
        again = middle(segment)
        if clip.repeats(at, sample) and again != at and again not in sample and not clip.repeats(again, sample):
            at = again
        if clip.repeats(at, sample):
            segments, stalled = [*segments[:chosen], (segment[0], at), (at, segment[1]), *segments[chosen + 1 :]], stalled + 1
        else:
            sample = sorted({*sample, at})
            segments, stalled, steps = segments_of(sample), 0, steps + 1
    return {"sample": filled(clip, sample, limit, split), "steps": steps, "forced": forced, "reason": reason}


def filled(clip: Clip, sample: list[int], limit: int, split=split_point) -> list[int]:
    """Splits of the largest gaps until there are ``limit`` frames or nothing to split."""
    while len(sample) < limit and (i := longest(segments_of(sample))) is not None:
        segment = segments_of(sample)[i]
        at = inner_split(clip, segment, split)
        sample = sorted({*sample, middle(segment) if clip.repeats(at, sample) else at})
    return sample


def guided_search(clip: Clip, pick: Pick, relevant: Callable[[int], bool], sure: Callable[[list[int]], int], fps: float, start: int = 4, least: int = 8, limit: int = 11, enough: int = 3, min_steps: int = 2, split: Callable[[Clip, Segment], int] = split_point) -> dict:
    """Frames of a screen recording, ``least`` to ``limit``, inside its content.

    ``pick`` may choose several segments a step, as many as the limit leaves room for (longest first). A new frame that
    repeats one of the sample is dropped and closes its segment; an irrelevant one gives way to a relevant one near it or
    is dropped. ``sure`` (1 to 3) ends the search from ``least`` frames and more than ``min_steps`` steps on. The largest gap
    is forced while the sample is out of balance. Too few frames at the end are filled up unless the answer is sure."""
    n, jump = clip.n, int(fps * 2)
    low, high = bounds = content_bounds(relevant, n, max(1, jump))

    def sampled(a: int, b: int) -> list[int]:
        size = b - a + 1
        return list(range(a, b + 1)) if size <= start else stepped(a, b, size // (start - 1))

    sample = [i for i in sampled(0, n - 1) if low <= i <= high] or sorted({low, high})
    if len(sample) < start and high - low > start:
        sample = sampled(low, high)
    closed: set[Segment] = set()
    steps, forced, trust = 0, 0, 0
    segments = segments_of(sample)
    for _ in range(limit + 10):
        if len(sample) >= limit:
            break
        if len(sample) >= least and steps > min_steps:
            trust = sure(sample)
            if trust >= enough:
                break
        able = [i for i, s in enumerate(segments) if can_split(s) and s not in closed]
        if not able:
            break
        wide = out_of_balance(sample) if len(sample) >= start + 2 else None
        if wide in segments and segments.index(wide) in able:
            chosen, forced = [segments.index(wide)], forced + 1
        else:
            chosen = [i for i in dict.fromkeys(pick(sample, segments, able)) if i in able] or [longest(segments, closed)]
        room = limit - len(sample)
        if len(chosen) > room:
            chosen = sorted(chosen, key=lambda i: (segments[i][0] - segments[i][1], i))[:room]
        fresh: list[int] = []
        for i in sorted(chosen):
            at = inner_split(clip, segments[i], split)
            if clip.repeats(at, [*sample, *fresh]):
                closed.add(segments[i])
            else:
                fresh.append(at)
        kept = {r for f in fresh if (r := replacement(relevant, f, sample, bounds)) is not None}
        grown = sorted({*sample, *kept})
        steps += len(grown) > len(sample)
        sample, segments = grown, segments_of(grown)
    if len(sample) < least and trust < enough:
        for _ in range(least + 5):
            i = longest(segments_of(sample), closed)
            if len(sample) >= least or i is None:
                break
            segment = segments_of(sample)[i]
            at = inner_split(clip, segment, split)
            if clip.repeats(at, sample):
                closed.add(segment)
            else:
                sample = sorted({*sample, at})
    return {"sample": sample, "steps": steps, "forced": forced, "trust": trust, "low": low, "high": high}


def agent_search(n: int, answer: Callable[[list[int]], int], ask: Callable[[list[int]], list[tuple[int, int]]], start: int = 5, limit: int = 16, rounds: int = 2, shown: int = 16) -> dict:
    """Frames of a video by rounds of an agent: it answers with a confidence of 1 to 3 and, below 3, asks for frames as
    (segment number, wanted frame); of each segment up to ``shown`` candidates are shown, of which the nearest to the wanted
    one joins the sample, the middle one where it names none (-1). Stops when sure, at the limit or after the rounds; the
    last round isn't answered."""
    sample = spaced(n, start)
    trust, steps = answer(sample), 1
    for turn in range(rounds):
        if trust >= 3 or len(sample) >= limit:
            break
        segments = segments_of(sample)
        new = set()
        for number, wanted in ask(sample):
            if not 0 <= number < len(segments):
                continue
            frames = list(range(*segments[number]))
            if len(frames) == 1:
                new.add(frames[0])
                continue
            few = frames[:: max(1, len(frames) // min(len(frames), shown))][:shown]
            new.add(min(few, key=lambda f: abs(f - wanted)) if wanted >= 0 else frames[len(frames) // 2])
        sample = sorted({*sample, *new})[:limit]
        if turn < rounds - 1:
            trust = answer(sample)
        steps += 1
    return {"sample": sample, "steps": steps, "trust": trust, "reason": "sure" if trust >= 3 else "rounds"}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def cosine_kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 20, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(cluster of each row, centres): start from k rows drawn at random, rows go to the centre of greatest cosine, empty
    clusters take a random row. Draws depend on ``seed`` alone."""
    rng = np.random.Generator(np.random.PCG64(seed))
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    unit, d = _unit(x), x.shape[1]
    for _ in range(rounds):
        near = np.argmax(np.round(unit @ _unit(centres).T, 12), 1)
        count = np.bincount(near, minlength=k)
        # all clusters' sums in one pass, each in the order of its rows
        new = np.bincount((near[:, None] * d + np.arange(d)).ravel(), x.ravel(), k * d).reshape(k, d) / np.maximum(count, 1)[:, None]
        for c in np.flatnonzero(count == 0):
            new[c] = x[rng.integers(len(x))]
        moved = np.sqrt(((new - centres) ** 2).sum(1)).sum()
        centres = new
        if moved**2 < tolerance:
            break
    return near, centres


def wide_enough(x: np.ndarray, relevance: Callable[[list[int]], list[int]], start: int = 8, most: int = 32, least: int = 4, seed: int = 0):
    """Adaptive breadth: clusters double from ``start`` to ``most`` until ``least`` representatives have relevance 3.

    (cluster of each row, {cluster: relevance}, representatives in order, number of clusters). A representative is the row
    nearest to its centre; relevance goes with the cluster that it stands for."""
    k = start
    while True:
        near, centres = cosine_kmeans(x, k, seed)
        nodes = {}
        for c in range(len(centres)):
            rows = np.flatnonzero(near == c)
            if len(rows):
                nodes[c] = int(rows[np.argmin(np.round(((x[rows] - centres[c]) ** 2).sum(1), 12))])
        order = sorted(nodes, key=nodes.get)
        score = dict(zip(order, relevance([nodes[c] for c in order])))
        if sum(v == 3 for v in score.values()) >= least or k >= most:
            return near, score, sorted(nodes.values()), k
        k = min(2 * k, most)


def ward_merges(x: np.ndarray) -> list[tuple[float, int, int]]:
    """(cost, row of one group, row of the other) of all merges by Ward's criterion, cheapest first, by chains of nearest
    neighbours: a chain goes on to the nearest group of its last one until two are each other's nearest, which merge.

    Costs come from the groups' means and sizes, so memory is that of the rows and time is quadratic. Of equally near groups
    the one that the chain came from wins, then the first."""
    mean, size, root = np.array(x, float), np.ones(len(x)), np.arange(len(x))
    alive, merges, chain = np.ones(len(x), bool), [], []
    for _ in range(len(x) - 1):
        if not chain:
            chain.append(int(alive.argmax()))
        while True:
            i = chain[-1]
            away = mean - mean[i]
            cost = np.where(alive, size[i] * size / (size[i] + size) * np.einsum("ij,ij->i", away, away), np.inf)
            cost[i] = np.inf
            j = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        merges.append((float(cost[j]), int(root[i]), int(root[j])))
        i, j = sorted((i, j))
        mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
        size[i] += size[j]
        alive[j] = False
        if len(x) - len(merges) < len(mean) // 2:  # what is left moves together, so that later steps read less
            left = np.flatnonzero(alive)
            place = np.cumsum(alive) - 1
            chain = [int(place[c]) for c in chain]
            mean, size, root, alive = mean[left], size[left], root[left], np.ones(len(left), bool)
    return sorted(merges, key=lambda m: m[0])


def ward(x: np.ndarray, k: int, merges: list[tuple[float, int, int]] | None = None) -> np.ndarray:
    """Labels of k clusters by Ward's criterion, numbered by first row; ``merges`` of the rows, if they are known."""
    n = len(x)
    if n <= k:
        return np.arange(n)  # nothing merges
    up = np.arange(n)

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for _, i, j in (ward_merges(x) if merges is None else merges)[: n - k]:
        a, b = sorted((top(i), top(j)))
        up[b] = a
    return np.unique([top(i) for i in range(n)], return_inverse=True)[1]


def _central(x: np.ndarray, rows: np.ndarray) -> int:
    """The row of greatest cosine with the mean of ``rows``, the first of equals."""
    if len(rows) == 1:
        return int(rows[0])
    part = x[rows]
    return int(rows[np.argmin(np.round(1 - _unit(part) @ _unit(part.mean(0, keepdims=True))[0], 12))])


def deep_enough(x: np.ndarray, near: np.ndarray, score: dict[int, int], width: int = 4) -> list[int]:
    """Depth by relevance: a cluster gives its representative; of relevance 2 also one of each of ``width`` Ward clusters,
    of relevance 3 one of each of their own ``width`` clusters. Parts of one row aren't divided further."""
    out: set[int] = set()
    for c in np.unique(near).tolist():
        rows = np.flatnonzero(near == c)
        value = score.get(c, 3)
        if value == 1 or len(rows) < 2:
            out.add(_central(x, rows))
            continue
        parts = [rows[lab] for lab in _parts(x[rows], width)]
        if value == 3:
            parts = [p[lab] for p in parts if len(p) > 1 for lab in _parts(x[p], width)]
            if not parts:
                continue
        out.add(_central(x, np.sort(np.concatenate(parts))))
        out.update(_central(x, p) for p in parts)
    return sorted(out)


def _parts(x: np.ndarray, width: int) -> list[np.ndarray]:
    if len(x) <= width:
        return [np.array([i]) for i in range(len(x))]
    label = ward(x, width)
    return [np.flatnonzero(label == i) for i in range(int(label.max()) + 1)]


def cluster_search(x: np.ndarray, relevance: Callable[[list[int]], list[int]], limit: int = 16, seed: int = 0) -> list[int]:
    """Rows of a video by breadth, then depth; thinned evenly to ``limit``, or filled up from the representatives."""
    if len(x) < 2:
        return list(range(len(x)))
    near, score, nodes, _ = wide_enough(x, relevance, seed=seed)
    return _within(deep_enough(x, near, score), nodes, limit)


def _within(found: list[int], nodes: list[int], limit: int) -> list[int]:
    if len(found) > limit:
        return [found[math.floor(i * len(found) / limit)] for i in range(limit)]
    return sorted([*found, *[i for i in nodes if i not in found][: limit - len(found)]])


class Clusters:
    """What cluster searches of one video have in common, whatever is asked: each number of clusters, and what a cluster gives at
    a relevance, is worked out once, when it is first needed."""

    def __init__(self, x: np.ndarray, seed: int = 0, width: int = 4):
        self.x, self.seed, self.width, self._levels, self._given = np.asarray(x, float), seed, width, {}, {}

    def level(self, k: int) -> list[tuple[int, np.ndarray]]:
        """(representative, rows) of k clusters, fewer if some are empty, in order of representatives."""
        if k not in self._levels:
            near, centres = cosine_kmeans(self.x, k, self.seed)
            rows = [np.flatnonzero(near == c) for c in range(len(centres))]
            away = [((self.x[r] - c) ** 2).sum(1) for r, c in zip(rows, centres)]
            self._levels[k] = sorted(((int(r[np.argmin(np.round(d, 12))]), r) for r, d in zip(rows, away) if len(r)), key=lambda c: c[0])
        return self._levels[k]

    def given(self, rows: np.ndarray, value: int) -> list[int]:
        """The rows that a cluster gives: see ``deep_enough``."""
        key = (rows.tobytes(), value)
        if key not in self._given:
            found = deep_enough(self.x[rows], np.zeros(len(rows), int), {0: value}, self.width)
            self._given[key] = rows[found].tolist()
        return self._given[key]

    def search(self, relevance: Callable[[list[int]], list[int]], limit: int = 16, start: int = 8, most: int = 32, least: int = 4) -> list[int]:
        """``cluster_search``."""
        n, k = len(self.x), start
        if n < 2:
            return list(range(n))
        while True:
            level = self.level(k)
            score = relevance([node for node, _ in level])
            if sum(v == 3 for v in score) >= least or k >= most:
                break
            k = min(2 * k, most)
        return _within(sorted({r for (_, rows), v in zip(level, score) for r in self.given(rows, v)}), [node for node, _ in level], limit)
