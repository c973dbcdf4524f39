"""Decoding, cropping and embedding with stand-ins."""

import os

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyframe.operators import pictures as P
from keyframe.sources import mp4


def test_decoded(spark):
    def shown(path, frames):
        if path == "bad":
            raise OSError(path)
        return [f"{path}:{i}".encode() if i < 100 else None for i in frames]

    asked = spark.createDataFrame([("v", "p", i % 70) for i in range(140)] + [("v", "p", 100), ("w", "bad", 1)], "video_id string, path string, frame int")
    known = spark.createDataFrame([("v", 3, bytearray(b"kept")), ("z", 1, bytearray(b"no"))], "video_id string, frame int, content binary")
    got = {(r.video_id, r.frame): r.content for r in P.decoded(asked, shown, known, most=16).collect()}
    assert got == {("v", i): b"kept" if i == 3 else f"p:{i}".encode() for i in range(70)} | {("v", 100): None, ("w", 1): None}
    assert P.decoded(asked.limit(0), shown).count() == 0


def test_recordings(spark):
    def probe(path):
        return {"a": (300, 25.0), "b": (0, 0.0)}[path]

    t = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c")], "video_id string, path string")
    assert {r.video_id: (r.n, r.fps, r.duration) for r in P.recordings(t, probe).collect()} == {"a": (300, 25.0, 12.0), "b": (0, 0.0, None), "c": (0, 0.0, None)}
    at = spark.range(3).select(P.frame_at(F.col("id") * 7.0, F.lit(25.0), F.lit(300)).alias("f"))
    assert [r.f for r in at.collect()] == [0, 175, 299]


def test_embedded(spark):
    def make():
        loaded = []  # a model's own state: how often it was called, and with how many

        def model(batch):
            loaded.append(len(batch))
            assert len(batch) <= 32
            return np.array([[len(b), 1.0] if b else [0.0, 0.0] for b in batch])

        return model

    t = spark.createDataFrame([(i, bytearray(b"x" * i) if i % 3 else None) for i in range(70)], "k int, content binary")
    got = {r.k: r.vec for r in P.embedded(t, make).collect()}
    assert got[3] == [0.0, 0.0] and np.allclose(got[4], np.array([4, 1]) / 17**0.5) and len(got) == 70


def test_crop_and_frame():
    picture = np.zeros((20, 30, 3), np.uint8)
    picture[5:9, 10:16] = 7
    assert P.content_box(picture) == (10, 5, 16, 9) and P.content_box(picture * 0) == (0, 0, 30, 20)
    assert P.cropped(picture, (0, 0, 13, 8)).shape == (3, 3, 3) and P.cropped(picture, (0, 0, 5, 5)).shape == (5, 5, 3)
    out = P.framed(picture, [(2, 2, 12, 12)], width=1)
    assert (out[2, 2:12] == (255, 0, 0)).all() and (out[11, 2:12] == (255, 0, 0)).all() and (out[2:12, 11] == (255, 0, 0)).all() and (out[3, 3] == 0).all() and (picture[2, 2] == 0).all()


def test_written(spark, tmp_path):
    t = spark.createDataFrame([("v", 1, bytearray(b"abc")), ("w", 2, None)], "v string, i int, content binary")
    rows = P.written(t, f"file://{tmp_path}", F.format_string("%s/frame_%04d.png", "v", "i")).collect()
    assert [(os.path.basename(r.path), r.bytes) for r in rows] == [("frame_0001.png", 3)] and open(rows[0].path, "rb").read() == b"abc"


def test_stored(spark, tmp_path):
    """A later run decodes what isn't in the store only; a run that is repeated adds nothing."""
    log = tmp_path / "log"
    log.touch()

    def decoder(path, frames):
        with open(log, "a") as f:
            f.writelines(f"{path} {i}\n" for i in frames)
        return [None if i == 3 else f"{path}{i}".encode() for i in frames]

    ask = lambda *rows: spark.createDataFrame([(v, f"/{v}", i) for v, i in rows], "video_id string, path string, frame int")
    store = f"file://{tmp_path}/s"
    one = P.stored(spark, ask(("a", 1), ("a", 3), ("b", 1), ("a", 1)), decoder, store, "r1")
    assert sorted((r.video_id, r.frame, r.content) for r in one.collect()) == [("a", 1, b"/a1"), ("a", 3, None), ("b", 1, b"/b1")]
    two = P.stored(spark, ask(("a", 3), ("a", 4)), decoder, store, "r2")
    assert sorted((r.frame, r.content) for r in two.collect()) == [(3, None), (4, b"/a4")]
    assert P.stored(spark, ask(("a", 3), ("a", 4)), decoder, store, "r2").count() == 2
    assert sorted(log.read_text().splitlines()) == ["/a 1", "/a 3", "/a 4", "/b 1"]


def box(name, *content, wide=False, size=None):
    body = b"".join(content)
    if wide:
        return struct.pack(">I4sQ", 1, name, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8 if size is None else size, name) + body


def track(kind, scale, runs, version=0):
    length = sum(n * d for n, d in runs)
    mdhd = struct.pack(">B3xIIII", 0, 0, 0, scale, length) if version == 0 else struct.pack(">B3xQQIQ", 1, 0, 0, scale, length)
    stts = struct.pack(">II", 0, len(runs)) + b"".join(struct.pack(">II", *r) for r in runs)
    return box(b"trak", box(b"tkhd", bytes(20)), box(b"mdia", box(b"mdhd", mdhd, bytes(4)), box(b"hdlr", bytes(8), kind, bytes(13)), box(b"minf", box(b"vmhd", bytes(12)), box(b"stbl", box(b"stsd", bytes(30)), box(b"stts", stts)))))


def film(*tracks, before=True, version=0, wide=False, last=False):
    mvhd = box(b"mvhd", struct.pack(">B3xIIII", 0, 0, 0, 1000, 5000), bytes(80))
    moov, mdat = box(b"moov", mvhd, *tracks), box(b"mdat", b"\0moov" * 5000, wide=wide, size=0 if last else None)
    return box(b"ftyp", b"isom") + (moov + mdat if before else mdat + moov)


@pytest.mark.parametrize("raw,want", [
    (film(track(b"vide", 12800, [(250, 512)])), (250, 25.0, 10.0)),
    (film(track(b"soun", 44100, [(400, 1024)]), track(b"vide", 90000, [(100, 3003), (1, 1500)], 1), before=False, wide=True), (101, 101 / (301800 / 90000), 301800 / 90000)),
    (film(track(b"vide", 600, [(7, 20)]), last=True), (7, 30.0, 7 / 30)),
    (film(track(b"vide", 600, [])), (0, 0.0, 5.0)),
])
def test_mp4(spark, tmp_path, raw, want):
    """Frames, rate and seconds of films built here, by few small reads; a recording without a video track has none."""
    reads = []

    def read(at, n):
        reads.append(n)
        return raw[at : at + n]

    got = mp4.metadata(read, len(raw))
    assert got[0] == want[0] and np.allclose(got[1:], want[1:]) and sum(reads) < 4000
    (tmp_path / "v.mp4").write_bytes(raw)
    (tmp_path / "no.mp4").write_bytes(film(track(b"soun", 44100, [(4, 1024)])))
    (tmp_path / "cut.mp4").write_bytes(raw[:37])
    t = spark.createDataFrame([(n, f"file://{tmp_path}/{n}.mp4") for n in ("v", "no", "cut", "gone")], "video_id string, path string")
    rows = {r.video_id: (r.n, r.fps) for r in P.recordings(t, mp4.probe).collect()}
    assert rows["v"][0] == want[0] and np.isclose(rows["v"][1], want[1]) and rows["no"] == rows["cut"] == rows["gone"] == (0, 0.0)
