"""Substring dedup by line hashing: lines, cut further at sentence ends, are normalised and hashed to 128 bits; of each
digest the earliest ranked occurrence (least doc_id, then place) stays and later ones go, by offsets into the original.

A line goes as a whole if all its units repeat earlier ones. Sentences inside other lines may repeat by chance where they
are short, so there removal looks at runs: consecutive units of a document that all repeat an earlier one go together
if the run has a unit of ``unit_words`` words or ``run_words`` words in all. ``line_words`` sets a least length for
lines too (none by default).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec
from ._scratch import Scratch

UNIT_WORDS, RUN_WORDS, LINE_WORDS = 8, 20, 0


def units(column: pa.Array):
    """Units of a slice of texts: (first unit of each row and the total, byte start, byte end, words, two hashes, whether
    a line starts with it).

    A unit ends after a word that ends in . ! or ?, and at each line feed; case and white space don't count."""
    h, first, begin, end = _vec.words(column)
    data, offsets = _vec.string_parts(column)
    if not len(h):
        z = np.zeros(0, np.int64)
        return np.zeros(len(column) + 1, np.int64), z, z, z, z, z, z
    last = data[end - 1]
    stop = (last == 46) | (last == 33) | (last == 63)
    feeds = np.concatenate(([0], np.cumsum(data == 10)))
    line = np.zeros(len(h), bool)  # words after which a line or a text ends
    line[:-1] = feeds[begin[1:]] > feeds[end[:-1]]
    line[first[1:][np.diff(first) > 0] - 1] = True
    stop |= line
    till = np.flatnonzero(stop) + 1
    at = np.concatenate(([0], till[:-1]))
    opens = np.concatenate(([True], line[till[:-1] - 1]))
    size = till - at
    place = np.arange(len(h)) - np.repeat(at, size)
    pw = _vec._powers(int(size.max()))[place]
    d1 = _vec.mix(np.add.reduceat(h * pw, at) + size.astype(np.uint64))
    d2 = _vec.mix(np.add.reduceat(_vec.mix(h + np.uint64(0x1234567)) * pw, at))
    return np.searchsorted(at, first), begin[at], end[till - 1], size, d1, d2, opens


KEY = ["rank_id", "key_1", "key_2"]


def _units_map(batches):
    for batch in batches:
        text = batch.column("text")
        for a, b in _vec.slices(text):
            first, _, _, _, d1, d2, _ = units(text[a:b])
            if not len(d1):
                continue
            count = np.diff(first)
            who = pa.array(np.repeat(np.arange(a, b), count))
            pos = np.arange(len(d1)) - np.repeat(first[:-1], count)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(who) for c in KEY), pa.array(pos.astype(np.int32)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], [*KEY, "pos", "d1", "d2"])


def _runs(flags: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags; a run ends where a text does."""
    before = np.concatenate(([False], flags[:-1]))
    after = np.concatenate((flags[1:], [False]))
    last = np.concatenate((opens[1:], [True]))
    return np.flatnonzero(flags & (~before | opens)), np.flatnonzero(flags & (~after | last)) + 1


def gone(flags: np.ndarray, size: np.ndarray, lines: np.ndarray, texts: np.ndarray, unit_words: int, run_words: int, line_words: int) -> np.ndarray:
    """Which units go: lines that repeat whole, and whole runs of flagged units that are long enough. ``lines``, ``texts``:
    whether a line, a text starts with a unit."""
    at = np.flatnonzero(lines)
    whole = np.logical_and.reduceat(flags, at) & (np.add.reduceat(size, at) >= line_words)
    out = np.repeat(whole, np.diff(np.append(at, len(flags))))
    start, end = _runs(flags, texts)
    if len(start):
        total = np.concatenate(([0], np.cumsum(size)))
        most = np.maximum.reduceat(np.append(size, 0), np.stack((start, end), 1).ravel())[::2]
        n = end - start
        out[np.flatnonzero(flags)] |= np.repeat((most >= unit_words) | (total[end] - total[start] >= run_words), n)
    return out


def cut_texts(column: pa.Array, repeats, unit_words: int = UNIT_WORDS, run_words: int = RUN_WORDS, line_words: int = LINE_WORDS):
    """(text without the removed units, [(start, end, words)] in code points of the original) of each text of a slice;
    ``repeats``: for each text the places of its units that repeat an earlier one, or None."""
    texts, spans = column.to_pylist(), [[] for _ in range(len(column))]
    first, start, end, size, _, _, lines = units(column)
    n = [0 if r is None else len(r) for r in repeats]
    if not len(start) or not sum(n):
        return texts, spans
    data, offsets = _vec.string_parts(column)
    flags = np.zeros(len(start), bool)
    flags[np.repeat(first[:-1], n) + np.concatenate([np.asarray(r, np.int64) for r in repeats if r is not None and len(r)])] = True
    opens = np.zeros(len(start), bool)
    opens[first[:-1][np.diff(first) > 0]] = True
    cut = gone(flags, size, lines, opens, unit_words, run_words, line_words)
    a, b = _runs(cut, opens)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    total = np.concatenate(([0], np.cumsum(size)))
    row = np.searchsorted(first, a, side="right") - 1
    head = chars[offsets[row]]
    found = zip(row.tolist(), (chars[start[a]] - head).tolist(), (chars[end[b - 1]] - head).tolist(), (total[b] - total[a]).tolist())
    for i, *span in found:
        spans[i].append(tuple(span))
    nxt = np.append(start[1:], len(data))
    nxt[first[1:][np.diff(first) > 0] - 1] = offsets[1:][np.diff(first) > 0]  # the last unit of a text goes to its end
    keep = np.ones(len(data) + 1, np.int8)
    if len(a):
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, start[a], 1)
        np.add.at(edge, nxt[b - 1], -1)
        keep = np.cumsum(edge) == 0
    for i in np.unique(row).tolist():
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        texts[i] = data[lo:hi][keep[lo:hi]].tobytes().decode()
    return texts, spans


def cut_text(text: str | None, repeats, *words: int):
    """``cut_texts`` of one text."""
    texts, spans = cut_texts(pa.array([text], pa.string()), [repeats], *words)
    return texts[0], spans[0]


CUT = "struct<text:string,removed:array<struct<start:int,end:int,words:int>>>"


def _cut_column(*words: int):
    """(text, repeats) to the text that stays and the removed spans. Evaluated once a row, whatever reads its fields."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))

    @F.arrow_udf(CUT)
    def cut(text: pa.Array, repeats: pa.Array) -> pa.Array:
        texts, spans = [], []
        for a, b in _vec.slices(text):
            t, found = cut_texts(text[a:b], repeats[a:b].to_pylist(), *words)
            texts += t
            spans += [[dict(zip(("start", "end", "words"), x)) for x in f] for f in found]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(spans, span)], ["text", "removed"])

    return cut.asNondeterministic()


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with rank_id (the doc_id; null ids last) and two hashes of the text, which tell rows apart."""
    text = F.col("text").cast("string")
    return docs.withColumns({"rank_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "key_1": F.xxhash64(text), "key_2": F.xxhash64(F.lit("text"), text)})


def repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(rank_id, key_1, key_2, repeats): the places of the units of each distinct row that repeat an earlier one.

    The grouping of digests combines before its shuffle. The digests that occur twice are written, so that their join to
    the units is of two shuffled sides, of which Spark splits partitions that a hot digest makes large. A unit passes as
    numbers, never as text."""
    scratch = Scratch(spark, "lines")
    u = keyed(docs).select(*KEY, F.col("text").cast("string").alias("text")).mapInArrow(_units_map, "rank_id long, key_1 long, key_2 long, pos int, d1 long, d2 long")
    dup = scratch.cut(u.groupBy("d1", "d2").agg(F.count("*").alias("k"), F.min(F.struct(*KEY, "pos")).alias("first")).where("k > 1").select("d1", "d2", "first"))
    scratch.sweep()
    later = u.join(dup, ["d1", "d2"]).where(F.struct(*KEY, "pos") != F.col("first")).select(*KEY, "pos")
    return later.groupBy(*KEY).agg(F.collect_set("pos").alias("repeats"))


def dedup(spark: SparkSession, docs: DataFrame, unit_words: int = UNIT_WORDS, run_words: int = RUN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """``docs`` with repeated units cut from text (and n_chars, if there is one, set to the new length).

    Ranks: least doc_id first (null ids last), then the text's hashes, then place in the text; within a document later
    repeats go as well. Null and empty texts stay as they are. Rows with equal id and text are one document and get the
    same result. All other columns stay, whatever their names; an empty table gives an empty result."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    ranked = keyed(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names))).alias("row")))
    out = ranked.join(repeats(spark, docs), KEY, "left")
    hit = F.col("repeats").isNotNull()
    out = out.withColumn("cut", _cut_column(unit_words, run_words, line_words)(F.when(hit, F.col(f"row.{text}").cast("string")), F.col("repeats")))
    new = {text: F.when(hit, F.col("cut.text")).otherwise(F.col(f"row.{text}"))}
    if "n_chars" in docs.columns:
        n = names[docs.columns.index("n_chars")]
        new[n] = F.when(F.size("cut.removed") > 0, F.length("cut.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"row.{n}"))
    return out.select(*(new.get(n, F.col(f"row.{n}")).alias(c) for c, n in zip(docs.columns, names)))


def removed(spark: SparkSession, docs: DataFrame, unit_words: int = UNIT_WORDS, run_words: int = RUN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """(doc_id, start_char, end_char, n_words): one row for each removed run, in code points of the original text; for
    rows that repeat an id and a text, one for each of them."""
    rows = keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).join(repeats(spark, docs.select("doc_id", "text")), KEY)
    cut = rows.select(F.col("doc_id").cast("long").alias("doc_id"), _cut_column(unit_words, run_words, line_words)("text", "repeats").alias("cut"))
    return cut.select("doc_id", F.explode("cut.removed").alias("r")).select("doc_id", F.col("r.start").alias("start_char"), F.col("r.end").alias("end_char"), F.col("r.words").alias("n_words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every removed run of the documents, short lines included."""
    return removed(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
