"""Keyframe selection as a DataFrame operator: a row carries one video's features, so any task can take any row and a
video that many questions ask about is no group of its own."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import video as V
from .search import STRATEGIES

FOUND = "frames array<int>, steps int, forced int, reason string"
#: The same in Arrow.
CHOSEN = [("frames", pa.list_(pa.int32())), ("steps", pa.int32()), ("forced", pa.int32()), ("reason", pa.string())]


def vector(x: pa.Scalar) -> np.ndarray:
    """A row's array of numbers."""
    return np.asarray(x.values.to_numpy(zero_copy_only=False), float)


def matrix(x: pa.Scalar) -> np.ndarray:
    """A row's array of arrays of one length."""
    rows = x.values
    wide = set(pc.list_value_length(rows).unique().to_pylist())
    if len(wide) == 1 and None not in wide:
        return np.asarray(rows.flatten().to_numpy(zero_copy_only=False), float).reshape(len(rows), -1)
    return np.stack([np.asarray(r, float) for r in rows.to_pylist()])  # which tells what is wrong


def found(got: dict) -> dict:
    """A method's outcome as a row of ``FOUND``."""
    return {"frames": [int(i) for i in got["sample"]], "steps": int(got.get("steps", 0)), "forced": int(got.get("forced", 0)), "reason": got["reason"]}


def clips(frames: DataFrame, part: str, order: str, hist: list[Column], sharp: Column, value: Column) -> DataFrame:
    """(part, hist, sharp, value): arrays over a video's frames in order; ``value`` is what a stand-in judge looks at."""
    row = F.struct(F.col(order).alias("o"), F.array(*(h.cast("double") for h in hist)).alias("h"), sharp.cast("double").alias("s"), value.cast("double").alias("v"))
    rows = frames.groupBy(part).agg(F.array_sort(F.collect_list(row)).alias("a"))
    return rows.select(part, F.col("a.h").alias("hist"), F.col("a.s").alias("sharp"), F.col("a.v").alias("value"))


class Look:
    """A judge's stand-in for one row: choices and confidences follow from the values and the question's number alone."""

    def __init__(self, value: np.ndarray, question: int, strategy: str = "a_star", level: float = 40.0):
        self.value, self.question, self.strategy, self.level = value, question, strategy, level

    def pick(self, sample, segments, able) -> list[int]:
        chosen = STRATEGIES[self.strategy](self.value, [segments[i] for i in able], 3)
        return [segments.index(s) for s in chosen]

    def relevant(self, frame: int) -> bool:
        return (self.value[frame] + self.question) % 97 >= self.level / 4

    def sure(self, sample) -> int:
        return 1 + zlib.crc32(repr((self.question, sample)).encode()) % 3

    def ask(self, sample) -> list[tuple[int, int]]:
        segments = V.segments_of(sample)
        wide = V.longest(segments)
        return [] if wide is None else [(wide, segments[wide][0] + self.question % max(1, segments[wide][1] - segments[wide][0]))]

    def relevance(self, rows) -> list[int]:
        return [1 + int(self.value[r] + self.question) % 3 for r in rows]


def _blind(clip, look):
    return {"sample": [], "reason": "no_frames"}


def _uniform(clip, look):
    return {"sample": V.spaced(clip.n, 16), "reason": "spaced"}


def _capped(clip, look):
    return V.capped_search(clip, look.pick)


def _guided(clip, look):
    return V.guided_search(clip, look.pick, look.relevant, look.sure, 2.0) | {"reason": "guided"}


def _agent(clip, look):
    return V.agent_search(clip.n, look.sure, look.ask)


def _cluster(clip, look):
    return {"sample": clip.clusters.search(look.relevance), "reason": "clusters"}


#: Methods by name: (clip, judge) to a sample and how it came about.
METHODS: dict[str, Callable] = {"blind": _blind, "uniform": _uniform, "capped": _capped, "guided": _guided, "agent": _agent, "cluster": _cluster}


def choose(rows: DataFrame, method: str, question: str, strategy: str = "a_star", methods: dict[str, Callable] | None = None) -> DataFrame:
    """``rows`` (features as ``clips`` makes them, and a question's number) with the chosen frames in place of the features.

    A row whose method raises has no frames and the error as its reason, so that one video doesn't end the run."""
    run_one = (methods or METHODS)[method]
    keys = [c for c in rows.columns if c not in ("hist", "sharp", "value")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for h, s, v, q in zip(f["hist"], f["sharp"], f["value"], f[question]):
                try:
                    clip = V.Clip(np.stack(list(h)), np.asarray(s))
                    got = run_one(clip, Look(np.asarray(v, float), int(q), strategy))
                except Exception as e:  # noqa: BLE001  a method may raise anything
                    got = {"sample": [], "reason": f"error: {type(e).__name__}"}
                out.append(([int(i) for i in got["sample"]], int(got.get("steps", 0)), int(got.get("forced", 0)), got["reason"]))
            yield pd.concat([f[keys].reset_index(drop=True), pd.DataFrame(out, columns=["frames", "steps", "forced", "reason"])], axis=1)

    keyed = rows.select(*keys).schema
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in keyed) + ", " + FOUND
    return rows.mapInPandas(run, schema)


def choose_packed(items: DataFrame, clips: DataFrame, method: str | list[str], question: str, part: str = "video", strategy: str = "a_star", pack: int = 64) -> DataFrame:
    """``items`` (part, question, other columns) with the frames chosen from the features of their part, a row for each of several
    methods, then with the column method. About ``pack`` items of a part travel together, so that its arrays are copied once
    for these and all methods, and a part that is asked about much is no single row. Results leave a task ``pack`` rows at a
    time."""
    several = [method] if isinstance(method, str) else method
    names = items.columns
    each = pa.list_(pa.struct([("method", pa.string()), *CHOSEN]))
    count = items.groupBy(part).agg(F.ceil(F.count("*") / pack).alias("packs_"))
    packed = items.join(count, part).groupBy(part, F.pmod(F.xxhash64(question), F.col("packs_")).alias("pack_")).agg(F.collect_list(F.struct(*names)).alias("items_"))
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a row takes far longer than its bytes tell, so they aren't merged by size
    rows = packed.repartition(n, part).join(clips.repartition(n, part), part).select("items_", F.transform("items_", lambda x: x[question].cast("long")).alias("questions_"), "hist", "sharp", "value")

    def one(h: pa.Scalar, s: pa.Scalar, v: pa.Scalar, questions: list[int]) -> list[list[dict]]:
        clip, seen, out = V.Clip(matrix(h), vector(s)), vector(v), []
        for q in questions:
            out.append([])
            for m in several:
                try:
                    got = METHODS[m](clip, Look(seen, q, strategy))
                except Exception as e:  # noqa: BLE001  a method may raise anything
                    got = {"sample": [], "reason": f"error: {type(e).__name__}"}
                out[-1].append({"method": m, **found(got)})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, pack):
                b = batch.slice(k, pack)
                made = [one(*x[:3], x[3].as_py()) for x in zip(*(b.column(c) for c in ("hist", "sharp", "value", "questions_")))]
                yield pa.RecordBatch.from_arrays([b.column("items_"), pa.array(made, pa.list_(each))], ["items_", "found_"])

    outcome = T.StructType([T.StructField("method", T.StringType()), *T.StructType.fromDDL(FOUND)])
    schema = rows.select("items_").schema.add("found_", T.ArrayType(T.ArrayType(outcome)))
    got = rows.mapInArrow(run, schema).select(F.explode(F.arrays_zip("items_", "found_")).alias("z")).select("z.items_", F.explode("z.found_").alias("f"))
    more = [] if isinstance(method, str) else ["f.method"]
    return got.select(*(F.col(f"items_.{c}").alias(c) for c in names), *more, "f.frames", "f.steps", "f.forced", "f.reason")
