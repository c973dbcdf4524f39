"""Elements of large nested JSON files: the entries of a file's outer object or array as rows, found by many tasks.

A file is cut into byte ranges. What a range means depends on what stands before it: whether it starts inside a string, and
how deep. A first pass sums up each range by itself (whether its quotes are odd, and how its brackets add up in either
case; a quote behind an odd number of backslashes is none), a fold over these few numbers gives each range its start, and
a second pass cuts out the entries whose separator stands in the range, reading on past its end for the last one."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT, CHUNK = 4 << 20, 1 << 20
_QUOTE, _BACK, _COMMA = 0x22, 0x5C, 0x2C
_STEP = np.zeros(256, np.int8)
_STEP[[0x5B, 0x7B]], _STEP[[0x5D, 0x7D]] = 1, -1


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes) of a file, or of the files in a folder whose names don't start with _ or a dot."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(p) if s.isFile() and s.getPath().getName()[:1] not in ("_", ".")]
    return spark.createDataFrame(found, "path string, bytes long")


def _open(path: str):
    fs, inner = pfs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.open_input_file(inner)


def _escaped(f, start: int) -> bool:
    """Whether the byte at ``start`` stands behind an odd number of backslashes."""
    n, at = 0, start
    while at > 0:
        low = max(0, at - 64)
        back = f.read_at(at - low, low)
        here = len(back) - len(back.rstrip(b"\\"))
        n += here
        if here < len(back):
            break
        at = low
    return n % 2 == 1


def _marks(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of quotes that open or close a string."""
    quotes = np.flatnonzero(data == _QUOTE)
    if not len(quotes):
        return quotes
    plain = np.flatnonzero(data != _BACK)  # the last byte before a quote that is no backslash tells how many there are
    before = np.searchsorted(plain, quotes) - 1
    last = np.where(before >= 0, plain[np.maximum(before, 0)], -1)
    run = quotes - last - 1 + np.where(last < 0, int(escaped), 0)
    return quotes[run % 2 == 0]


def _inside(data: np.ndarray, marks: np.ndarray, start: bool) -> np.ndarray:
    """Whether each byte is part of a string (its opening quote included)."""
    turn = np.zeros(len(data) + 1, np.int8)
    turn[marks] = 1
    return (np.cumsum(turn[:-1]) + start) % 2 == 1


def _sum_map(batches):
    for batch in batches:
        out = []
        for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
            with _open(path) as f:
                odd, deltas = False, [0, 0]
                for a in range(start, end, CHUNK):
                    data = np.frombuffer(f.read_at(min(CHUNK, end - a), a), np.uint8)
                    marks = _marks(data, _escaped(f, a))
                    outside = _STEP[data[~_inside(data, marks, odd)]].sum(dtype=np.int64), _STEP[data[_inside(data, marks, odd)]].sum(dtype=np.int64)
                    deltas = [deltas[0] + int(outside[0]), deltas[1] + int(outside[1])]
                    odd ^= bool(len(marks) % 2)
            out.append((path, start, end, odd, *deltas))
        cols = list(zip(*out))
        if cols:
            types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["path", "start", "end", "odd", "out_delta", "in_delta"])


class _Scan:
    """Separators of the outer level from a place on, chunk by chunk."""

    def __init__(self, f, at: int, size: int, inside: bool, depth: int):
        self.f, self.at, self.size, self.inside, self.depth = f, at, size, inside, depth

    def chunks(self):
        """(first byte, bytes, places of separators: outer commas, the outer bracket and its end)."""
        while self.at < self.size:
            raw = self.f.read_at(CHUNK, self.at)
            data = np.frombuffer(raw, np.uint8)
            marks = _marks(data, _escaped(self.f, self.at))
            inside = _inside(data, marks, self.inside)
            step = np.where(inside, 0, _STEP[data]).astype(np.int64)
            depth = self.depth + np.cumsum(step)
            found = np.flatnonzero(~inside & ((depth == 1) & ((data == _COMMA) | (step == 1)) | (depth == 0) & (step == -1)))
            yield self.at, raw, found
            self.inside ^= bool(len(marks) % 2)
            self.depth, self.at = int(depth[-1]), self.at + len(raw)


def _entry(raw: bytes):
    """(key, value) of what stands between two separators; None where that is nothing."""
    text = raw.decode().strip()
    if not text:
        return None
    if text[0] == '"':
        key, end = json.JSONDecoder().raw_decode(text)
        rest = text[end:].lstrip()
        if rest.startswith(":"):
            return key, rest[1:].strip()
    return None, text


def _cut_map(batches):
    def made(rows):
        cols = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["path", "place", "key", "value"])

    for batch in batches:
        rows, held = [], 0
        for path, start, end, size, inside, depth in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end", "bytes", "inside", "depth"))):
            with _open(path) as f:
                place, parts, done = None, [], False
                for at, raw, found in _Scan(f, start, size, inside, depth).chunks():
                    last = 0
                    for x in found.tolist():
                        if place is not None:
                            parts.append(raw[last:x])
                            if (entry := _entry(b"".join(parts))) is not None:
                                rows.append((path, place, *entry))
                                held += len(entry[1])
                        closes = raw[x] in b"]}"
                        place, parts, last = None if closes else at + x, [], x + 1
                        if held > CHUNK:
                            yield made(rows)
                            held = 0
                        if done := place is not None and place >= end or closes and at + x >= end:
                            break
                    if done or place is None and at + len(raw) >= end:
                        break
                    if place is not None:
                        parts.append(raw[last:])
        if rows:
            yield made(rows)


def elements(spark: SparkSession, root: str, split: int = SPLIT) -> DataFrame:
    """(path, place, key, value): a row for each entry of the outer object or array of every file; ``place`` is the byte of the
    separator before it, so that it orders a file's entries, ``key`` is null in arrays, ``value`` is JSON text as it stands.

    Keys that repeat give a row each. Empty files, objects and arrays give no rows, as do files that hold a bare value. The
    values of one entry are one row. ``root`` is read by its own file system, wherever a task runs."""
    found = files(spark, root)
    ranges = found.where("bytes > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))))
    ranges = ranges.withColumn("end", F.least(F.col("start") + split, F.col("bytes")))
    spread = lambda df: df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    sums = spread(ranges).mapInArrow(_sum_map, "path string, start long, end long, odd boolean, out_delta long, in_delta long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("long")).over(before), F.lit(0)) % 2 == 1)
    sums = sums.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside"), F.col("in_delta")).otherwise(F.col("out_delta"))).over(before), F.lit(0)))
    known = sums.join(found, "path").select("path", "start", "end", "bytes", "inside", "depth")
    return spread(known).mapInArrow(_cut_map, "path string, place long, key string, value string")


def write_objects(rows: DataFrame, key: str, value: str, root: str) -> None:
    """``rows`` as nested files: one JSON object for each task, an entry for each row; ``value`` is JSON text already."""

    def run(batches):
        first = True
        for batch in batches:
            out = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.append(("{" if first else ",\n") + json.dumps(k, ensure_ascii=False) + ": " + v)
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["{}" if first else "}"])], ["value"])

    lines = rows.select(F.col(key).cast("string"), F.col(value).cast("string")).mapInArrow(run, "value string")
    lines.write.mode("overwrite").option("lineSep", "\n").text(root)
