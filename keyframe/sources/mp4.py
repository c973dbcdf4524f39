"""Frames, rate and length of MP4 recordings from their headers: boxes are stepped over by their sizes, and only those that
tell are read, so that a recording of any size costs some small ranged reads.

A box is a size of 4 bytes and a name of 4; size 1 stands for a size of 8 bytes behind the name, 0 for the rest of the
file. moov/mvhd has the time scale and length of the whole, moov/trak a track: mdia/mdhd its own time scale and length,
mdia/hdlr its kind, mdia/minf/stbl/stts runs of (number of frames, time units of each)."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow.fs as pfs

Read = Callable[[int, int], bytes]
#: Bytes of a table of runs that are read at once.
PIECE = 1 << 20


def boxes(read: Read, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, end) of the content of each box in a range; a box that says it is longer ends with the range."""
    while start + 8 <= end:
        head = read(start, 16)
        if len(head) < 8:
            return
        size, name, body = struct.unpack(">I", head[:4])[0], head[4:8], 8
        if size == 1:
            if len(head) < 16:
                return
            size, body = struct.unpack(">Q", head[8:16])[0], 16
        size = size or end - start
        if size < body:
            return  # no box: what follows can't be found
        yield name, start + body, min(end, start + size)
        start += size


def inside(read: Read, start: int, end: int, *names: bytes) -> Iterator[tuple[int, int]]:
    """The ranges of all boxes that a path of names leads to."""
    for name, a, b in boxes(read, start, end):
        if name == names[0]:
            if len(names) == 1:
                yield a, b
            else:
                yield from inside(read, a, b, *names[1:])


def _scale(read: Read, at: int) -> tuple[int, int]:
    """(time scale, length in it) of a header of a film or a track, of either version."""
    raw = read(at, 32)
    return struct.unpack(">IQ", raw[20:32]) if raw[0] == 1 else struct.unpack(">II", raw[12:20])


def _runs(read: Read, at: int, end: int) -> tuple[int, int]:
    """(frames, time units) of a table of runs."""
    n = struct.unpack(">I", read(at + 4, 4))[0]
    frames = units = 0
    at += 8
    stop = min(end, at + 8 * n)
    while at + 8 <= stop:
        raw = read(at, min(PIECE, (stop - at) // 8 * 8))
        if len(raw) < 8:
            break
        for count, delta in struct.iter_unpack(">II", raw[: len(raw) // 8 * 8]):
            frames, units = frames + count, units + count * delta
        at += len(raw)
    return frames, units


def metadata(read: Read, size: int) -> tuple[int, float, float]:
    """(frames, frames a second, seconds) of the first video track. ValueError where there is none."""
    for trak in inside(read, 0, size, b"moov", b"trak"):
        kind = next(inside(read, *trak, b"mdia", b"hdlr"), None)
        if kind is None or read(kind[0] + 8, 4) != b"vide":
            continue
        head, table = next(inside(read, *trak, b"mdia", b"mdhd"), None), next(inside(read, *trak, b"mdia", b"minf", b"stbl", b"stts"), None)
        if head is None or table is None:
            continue
        (scale, length), (frames, units) = _scale(read, head[0]), _runs(read, *table)
        if not scale:
            break
        if not frames:  # fragments follow; the film's own length is all there is
            film = next(inside(read, 0, size, b"moov", b"mvhd"), None)
            scale, length = _scale(read, film[0]) if film else (scale, length)
            return 0, 0.0, length / scale if scale else 0.0
        seconds = (units or length) / scale
        return frames, frames / seconds if seconds else 0.0, seconds
    raise ValueError("no video track")


def probe(path: str) -> tuple[int, float]:
    """(frames, frames a second) of a recording, for ``pictures.recordings``; ``path`` is a URI or a local path."""
    fs, inner = pfs.FileSystem.from_uri(path) if "://" in path else (pfs.LocalFileSystem(), path.removeprefix("file:"))
    with fs.open_input_file(inner) as f:
        frames, rate, _ = metadata(lambda at, n: f.read_at(n, at), f.size())
    return frames, rate
