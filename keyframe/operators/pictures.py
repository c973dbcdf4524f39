"""Frames as pictures: decoding, cropping and embedding behind plug-ins, as no decoder or model is part of the engine.

A decoder takes a recording's path and frame numbers and gives a picture's bytes (or None) for each. Requests are rows;
one recording's are decoded together, and what has been decoded once is a table that later requests are looked up in.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow.fs as pfs
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyframe.sources.checkpoint import Checkpoint

Decoder = Callable[[str, list[int]], list[bytes | None]]


def frame_at(seconds: Column, fps: Column, n: Column) -> Column:
    """The frame shown at a time, within the recording."""
    return F.greatest(F.lit(0), F.least(n - 1, F.floor(seconds * fps))).cast("int")


def recordings(paths: DataFrame, probe: Callable[[str], tuple[int, float]]) -> DataFrame:
    """(video_id, path, n, fps, duration) of ``paths(video_id, path)``; ``probe`` gives the number of frames and the rate. A
    recording that doesn't open has no frames, rate or duration."""

    def run(frames):
        for f in frames:
            got = []
            for p in f["path"]:
                try:
                    n, fps = probe(p)
                    got.append((n, fps, n / fps if fps > 0 else None))
                except Exception:  # noqa: BLE001  a probe may raise anything
                    got.append((0, 0.0, None))
            yield pd.concat([f.reset_index(drop=True), pd.DataFrame(got, columns=["n", "fps", "duration"])], axis=1)

    return paths.select("video_id", "path").mapInPandas(run, "video_id string, path string, n int, fps double, duration double")


def decoded(requests: DataFrame, decoder: Decoder, known: DataFrame | None = None, most: int = 64) -> DataFrame:
    """(video_id, frame, content) of ``requests(video_id, path, frame)``, each frame once: from ``known(video_id, frame,
    content)`` where it is there, else decoded, ``most`` frames of a recording at a time. Frames that don't decode have
    null content."""
    wanted = requests.select("video_id", "path", F.col("frame").cast("int").alias("frame")).distinct()
    missing = wanted if known is None else wanted.join(known.select("video_id", "frame"), ["video_id", "frame"], "left_anti")
    jobs = missing.withColumn("slice", F.floor(F.col("frame") / most)).groupBy("video_id", "path", "slice").agg(F.array_sort(F.collect_list("frame")).alias("frames"))

    def run(frames):
        for f in frames:
            rows = []
            for video, path, numbers in zip(f["video_id"], f["path"], f["frames"]):
                numbers = [int(i) for i in numbers]
                try:
                    pictures = decoder(path, numbers)
                except Exception:  # noqa: BLE001  a decoder may raise anything
                    pictures = [None] * len(numbers)
                rows += [(video, i, p) for i, p in zip(numbers, pictures)]
            yield pd.DataFrame(rows, columns=["video_id", "frame", "content"])

    new = jobs.select("video_id", "path", "frames").mapInPandas(run, "video_id string, frame int, content binary")
    if known is None:
        return new
    return new.unionByName(known.select("video_id", "frame", "content").join(wanted.select("video_id", "frame"), ["video_id", "frame"], "left_semi"))


def embedded(pictures: DataFrame, make: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = 32, content: str = "content", shape: list[int] | None = None) -> DataFrame:
    """``pictures`` with vec in place of ``content``: unit vectors of a model. ``make`` loads it, once in each worker, and it is given
    ``batch`` pictures at a time (bytes, or where the column holds arrays of numbers, one array of ``shape`` each), whatever the
    batches between Spark and the worker are; what isn't a picture comes as empty bytes, for which a model shows a blank one."""

    def load():
        model = make()

        def predict(inputs: np.ndarray) -> np.ndarray:
            x = np.asarray(model(inputs), float)
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

        return predict

    run = predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch, input_tensor_shapes=[shape] if shape else None)
    shown = F.coalesce(F.col(content), F.lit(b"")) if pictures.schema[content].dataType == T.BinaryType() else F.col(content)
    return pictures.withColumn("vec", run(shown)).drop(*({content} - {"vec"}))


def stored(spark: SparkSession, requests: DataFrame, decoder: Decoder, store: str, run: str, most: int = 64) -> DataFrame:
    """The frames that are asked for, from the store of all that was decoded before; what isn't there is decoded and added as
    the batch ``run``, once however often that is repeated. Frames that didn't decode are kept as such."""
    kept = Checkpoint(spark, store)
    known = kept.read()
    wanted = requests.select("video_id", F.col("frame").cast("int").alias("frame")).distinct()
    missing = requests if known is None else requests.join(known.select("video_id", "frame"), ["video_id", "frame"], "left_anti")
    kept.commit(run, decoded(missing, decoder, most=most))
    return kept.read().join(wanted, ["video_id", "frame"], "left_semi")


def content_box(picture: np.ndarray) -> tuple[int, int, int, int]:
    """(left, top, right, bottom) of what isn't black; the whole picture where all is."""
    seen = np.argwhere(picture.max(-1) > 0 if picture.ndim == 3 else picture > 0)
    if not len(seen):
        return 0, 0, picture.shape[1], picture.shape[0]
    (top, left), (bottom, right) = seen.min(0), seen.max(0) + 1
    return int(left), int(top), int(right), int(bottom)


def cropped(picture: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """A picture cut to a box (left, top, right, bottom), then to what isn't black."""
    left, top, right, bottom = box
    part = picture[max(0, top) : bottom, max(0, left) : right]
    left, top, right, bottom = content_box(part)
    return part[top:bottom, left:right]


def framed(picture: np.ndarray, boxes, colour=(255, 0, 0), width: int = 3) -> np.ndarray:
    """A copy of a picture with the borders of boxes drawn."""
    out = picture.copy()
    for left, top, right, bottom in boxes:
        out[top : top + width, left:right] = out[max(top, bottom - width) : bottom, left:right] = colour
        out[top:bottom, left : left + width] = out[top:bottom, max(left, right - width) : right] = colour
    return out


def written(pictures: DataFrame, root: str, name: Column) -> DataFrame:
    """(path, bytes) of the files that the content of ``pictures`` is written to below ``root``, a URI of storage that all
    tasks reach. A task that runs again writes the same files again."""
    rows = pictures.select(name.alias("name"), "content").where("content is not null")

    def run(frames):
        fs, base = pfs.FileSystem.from_uri(root)
        for f in frames:
            out = []
            for n, content in zip(f["name"], f["content"]):
                path = f"{base}/{n}"
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(path, compression=None) as file:
                    file.write(io.BytesIO(content).getbuffer())
                out.append((path, len(content)))
            yield pd.DataFrame(out, columns=["path", "bytes"])

    return rows.mapInPandas(run, "path string, bytes long")


def scene_jobs(videos: DataFrame, local: DataFrame, whole: bool = False) -> DataFrame:
    """(video_id, ok, i, at_sec, box): a row for each scene of a local recording, with its own box or the first one (none for
    ``whole`` frames); one row with ok false for a recording that isn't there. ``videos``: video_id, at (seconds), boxes."""
    here = videos.join(local.select("video_id").distinct().withColumn("ok", F.lit(True)), "video_id", "left")
    rows = here.select("video_id", F.coalesce("ok", F.lit(False)).alias("ok"), "boxes", F.posexplode_outer(F.when(F.col("ok"), F.col("at"))).alias("i", "at_sec"))
    box = F.coalesce(F.get("boxes", F.col("i")), F.get("boxes", F.lit(0)))
    return rows.select("video_id", "ok", "i", "at_sec", F.when(F.col("ok") & F.lit(not whole), box).alias("box"))
