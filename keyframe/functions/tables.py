"""Table functions for Spark SQL: segments, splits and samples of a video by LATERAL, the strategy as an argument.

    SELECT v.video, s.* FROM videos v, LATERAL sample_frames(v.n, 16, 'linspace') s
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from keyframe.operators.search import split_others


@udtf(returnType="seg_id int, seg_start int, seg_end int, gap int")
class FrontierSegments:
    """The segments between the frames of a sample, numbered from 1; with ``least``, those of that gap at least."""

    def eval(self, frames: list, least: int = 0):
        at = sorted({f for f in frames or [] if f is not None})
        for i, (a, b) in enumerate(zip(at, at[1:]), 1):
            if b - a >= least:
                yield i, a, b, b - a


@udtf(returnType="seg_start int, seg_end int")
class SplitSegments:
    """The segments of a sample after those named by their first frames are halved; ``others``: retain, prune or merge."""

    def eval(self, frames: list, chosen: list, others: str):
        at = sorted({f for f in frames or [] if f is not None})
        segments = list(zip(at, at[1:]))
        wanted = [s for s in segments if s[0] in set(chosen or [])]
        if segments:
            yield from split_others(segments, wanted, others, at[-1])


@udtf(returnType="pos int, frame int")
class SampleFrames:
    """``k`` of the frames 0 to n - 1, all where there are no more. ``how``: linspace (down), rounded (half to even), stride, or
    interval: every k-th and the last."""

    def eval(self, n: int, k: int, how: str):
        if n is None or n < 1:
            return
        if how == "interval":
            at = sorted({*range(0, n, k), n - 1})
        elif n <= k:
            at = list(range(n))
        elif how == "linspace":
            at = [i * (n - 1) // (k - 1) for i in range(k)]
        elif how == "rounded":
            at = [round(i * (n - 1) / (k - 1)) for i in range(k)]
        elif how == "stride":
            at = [i * n // k for i in range(k)]
        else:
            raise ValueError(f"no such way to sample: {how}")
        yield from enumerate(at)


#: Names under which they are registered.
FUNCTIONS = {"frontier_segments": FrontierSegments, "split_segments": SplitSegments, "sample_frames": SampleFrames}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
