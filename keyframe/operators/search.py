"""Keyframe search per video: bounded loops in grouped pandas functions, a strategy per name, a judge that scores
segments. A group is one video's frames; videos spread over tasks, and no Spark job runs per step.

``judge(row of features, segment)`` is arithmetic on the segment's frames here; a client of a model has the same form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def longest(segments, k: int = 1):
    """The k longest segments that can be split, earlier ones first among equals."""
    able = [s for s in segments if s[1] - s[0] > 1]
    return sorted(able, key=lambda s: (-(s[1] - s[0]), s[0]))[:k]


def frontier(sample):
    return list(zip(sample, sample[1:]))


def relevance(v, s):
    part = v[s[0] + 1 : s[1]]
    return float(part.max()) if len(part) else -1.0


def change(v, s):
    return float(abs(v[s[1]] - v[s[0]]))


def coverage(s, mean):
    """0 for a segment that is sparsely covered, 2 for a densely covered one: by its length over the mean."""
    size = s[1] - s[0]
    return 0 if 2 * size > 3 * mean else 2 if 2 * size < mean else 1


def adaptive(v, segs, beam):
    """The best of the sparsest segments, so that the sample spreads before it digs deeper."""
    mean = sum(s[1] - s[0] for s in segs) / max(1, len(segs))
    return sorted(segs, key=lambda s: (coverage(s, mean), -(relevance(v, s) + change(v, s)), s[0]))[:1]


#: Which segments to open next: (values, segments that can be split, beam).
STRATEGIES = {
    "bfs": lambda v, segs, beam: longest(segs, beam),
    "gbfs": lambda v, segs, beam: sorted(segs, key=lambda s: (-relevance(v, s), s[0]))[:1],
    "dijkstra": lambda v, segs, beam: sorted(segs, key=lambda s: (-change(v, s), s[0]))[:1],
    "a_star": lambda v, segs, beam: sorted(segs, key=lambda s: (-(relevance(v, s) + change(v, s)), s[0]))[:1],
    "adaptive": adaptive,
}


def tree_search(frames: DataFrame, strategy: str, interval: int = 20, beam: int = 3, steps: int = 4, others: str = "retain") -> DataFrame:
    """(video, answer, at_step, n_frames, frames): the caption search of each video.

    The sample starts with every ``interval``-th frame. A step answers from the sample and, while there is no answer,
    opens segments at their middles: bfs once, several at a time, the other strategies one at a time, ``beam`` times.
    Without an answer in ``steps`` steps all frames seen are asked about once more, then directly."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("idx")
        got = answered_search(f["v"].to_numpy(float), STRATEGIES[strategy], spread_answer(f["v"].to_numpy(float)), interval, 1 if strategy == "bfs" else beam, steps, others, beam)
        return pd.DataFrame([{"video": f["video"].iloc[0], **got}])

    return frames.groupBy("video").applyInPandas(run, "video long, answer int, at_step string, n_frames int, frames array<int>")


def spread_answer(v):
    """A stand-in for two answer routes, (s, confidence, r, confidence): one is sure once the sample spans nearly all of what
    there is, the other once there are many frames."""
    whole = float(np.ptp(v)) + 1

    def answer(sample):
        part = float(np.ptp(v[sample])) if len(sample) else 0.0
        s, r = int(sum(sample)) % 5, int(len(sample) + sample[-1]) % 5
        return s, 1 + int(2.1 * part / whole), r, 1 + len(sample) // 9

    return answer


def split_others(segments, chosen, others: str, last: int):
    """Segments after the chosen ones are halved: ``retain`` keeps the others, ``prune`` drops them, ``merge`` puts a segment
    in each gap between the chosen, up to the last frame."""
    out, at = [], segments[0][0] if segments else 0
    for s in segments:
        if s in chosen:
            if others == "merge" and at < s[0]:
                out.append((at, s[0]))
            m = (s[0] + s[1]) // 2
            out += [(s[0], m), (m, s[1])] if s[1] - s[0] > 1 else [s]
            at = s[1]
        elif others == "retain":
            out.append(s)
    if others == "merge" and at < last:
        out.append((at, last))
    return out


def answered_search(v, pick, answer, interval: int, rounds: int, steps: int, others: str, beam: int, least: int = 3) -> dict:
    n = len(v)
    sample = list(range(0, n, interval))
    seen, segments, result, at = set(sample), frontier(sample), -1, None

    def both(frames, label):
        s, s_sure, r, r_sure = answer(frames)
        if s != -1 and s_sure >= least:
            return s, f"{label}_s_qa"
        return (r, f"{label}_r_qa") if r != -1 and r_sure >= least else (-1, None)

    for step in range(1, steps + 1):
        result, at = both(sample, step)
        if result != -1:
            break
        for _ in range(rounds):
            able = [s for s in segments if s[1] - s[0] > 1]
            if not able:
                break
            segments = split_others(segments, pick(v, able, beam), others, n - 1)
            sample = sorted({i for s in segments for i in s})
        seen |= set(sample)
    if result == -1:
        result, at = both(sorted(seen), "post")
    if result == -1:
        result, at = answer(sorted(seen))[0], "final_direct_qa"
    return {"answer": result, "at_step": at, "n_frames": len(seen), "frames": sorted(seen)}


def force_fill(frames: DataFrame, limit: int = 8) -> DataFrame:
    """(video, frame): both ends, then midpoints of the largest gap, the first of equals."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        n = len(f)
        sample = sorted({0, n - 1})
        while len(sample) < limit and (s := longest(frontier(sample))):
            sample = sorted([*sample, (s[0][0] + s[0][1]) // 2])
        return pd.DataFrame({"video": f["video"].iloc[0], "frame": sample})

    return frames.groupBy("video").applyInPandas(run, "video long, frame int")
