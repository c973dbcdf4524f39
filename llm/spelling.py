"""Spelling variants of a corpus by a symmetric-delete join.

Words are counted in each task and summed. Each word that is frequent enough emits itself and its deletions of one code
point, as 127-bit hashes of what is left with the place of the deletion, and all rows meet by the hash. Exactly at distance
one are, and no others: a word and a deletion equal to it (one code point inserted), and two deletions at the same place
(one replaced; where the places differ, so do the words in two code points, and nothing is made of them). So a word's near
words are counted and its most frequent one is found by windows over rows that share a hash, without pairs. No such group
exceeds an alphabet of 90 letters times the places.

A form is the most frequent near word, if it is ``ratio`` times as frequent; forms are followed to their roots by joins that
double the steps each time. Numbers stand for words, in code-point order, so that no row repeats a long word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_CHARS, LEAST_COUNT, RATIO, EVERY = 6, 5, 5, 199
#: Code points of a text that are split at once, words and bytes of them that a task counts before it passes them on.
PIECE, MOST_WORDS, MOST_BYTES = 1 << 20, 1 << 17, 16 << 20
_P, _BASE = (1 << 127) - 1, 0x2545F4914F6CDD1D9E3779B97F4A7C15
_LOW = (1 << 63) - 1


def runs(text: str):
    """Lists of the runs of letters of a text, a piece of it at a time; no run is cut."""
    a = 0
    while a < len(text):
        b = min(len(text), a + PIECE)
        if b < len(text) and RUN.match(text, b - 1) and (m := RUN.match(text, b)):
            b = m.end()
        yield RUN.findall(text, a, b)
        a = b


def damaged(doc: str, run: str, every: int = EVERY) -> str:
    """The lower-cased run, without one code point where ``every`` divides the hash of document and run."""
    raw = run.encode().lower()  # of bytes, only A-Z have lower case
    h = zlib.crc32(raw, zlib.crc32(f"{doc}:".encode()))
    word = raw.decode()
    if every and h % every == 0:
        at = h % len(word)
        word = word[:at] + word[at + 1 :]
    return word


def _count_map(least: int, every: int):
    def emit(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches):
        counts, size = Counter(), 0
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                for found in runs(text or ""):
                    for raw, n in Counter(r for r in found if len(r) >= least).items():
                        word = damaged(doc, raw, every)
                        if len(word) >= least:
                            if word not in counts:
                                size += len(word)
                            counts[word] += n
                    if len(counts) > MOST_WORDS or size > MOST_BYTES:
                        yield emit(counts)
                        counts, size = Counter(), 0
        if counts:
            yield emit(counts)

    return run


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) of that length and number at least; ``every`` 0 damages none."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_count_map(least_chars, every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def deletions(word: str) -> list[int]:
    """Hashes of the word and of what is left without its first, second ... code point."""
    n = len(word)
    codes = [ord(c) for c in word]
    power, after = [1] * n, [0] * (n + 1)
    for i in range(1, n):
        power[i] = power[i - 1] * _BASE % _P
    for i in range(n - 1, -1, -1):
        after[i] = (codes[i] * power[n - 1 - i] + after[i + 1]) % _P
    out, before = [after[0]], 0
    for i in range(n):
        out.append((before * power[n - 1 - i] + after[i + 1]) % _P)
        before = (before * _BASE + codes[i]) % _P
    return out


def _delete_map(batches):
    """A row for the word itself (at -1) and for each place; ``first``: the first place that leaves this."""
    for batch in batches:
        high, low, at, first, ids, ns = [], [], [], [], [], []

        def emit():
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
            done = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((high, low, at, first, ids, ns), kinds)], ["high", "low", "at", "first", "id", "n"])
            for x in (high, low, at, first, ids, ns):
                x.clear()
            return done

        for i, word, n in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "n"))):
            for k, h in enumerate(deletions(word), -1):
                high.append((h >> 63) - (1 << 63))
                low.append(h & _LOW)
                at.append(k)
                first.append(k == 0 or k > 0 and word[k] != word[k - 1])
                ids.append(i)
                ns.append(n)
                if len(ids) >= 1 << 16:
                    yield emit()
        if ids:
            yield emit()


def _best(n: str = "n", i: str = "id"):
    return F.struct((-F.col(n)).alias("less"), F.col(i).alias("id"))


def near(words: DataFrame) -> DataFrame:
    """(id, n_near, best(less, id)) of ``words(id, word, n)``: how many words are at distance one, and the most frequent of
    them (the least id of several) with its number, negated. Words without any are left out."""
    rows = words.select("id", "word", "n").mapInArrow(_delete_map, "high long, low long, at int, first boolean, id long, n long").repartition("high", "low")
    placed = Window.partitionBy("high", "low", "at").orderBy(F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    keyed = Window.partitionBy("high", "low")
    rows = rows.withColumns({"alike": F.count("*").over(placed) - 1, "top": F.first(_best()).over(placed), "second": F.nth_value(_best(), 2).over(placed)})
    itself, longer = F.col("at") == -1, F.col("first")
    rows = rows.withColumns({"short": F.min(F.when(itself, _best())).over(keyed), "n_long": F.sum(longer.cast("long")).over(keyed), "long": F.min(F.when(longer, _best())).over(keyed)})
    other = F.when(F.col("top.id") == F.col("id"), F.col("second")).otherwise(F.col("top"))
    shorter = F.when(longer, F.col("short"))
    found = rows.select("id", F.when(itself, F.col("n_long")).otherwise(F.col("alike") + shorter.isNotNull().cast("long")).alias("k"), F.when(itself, F.col("long")).otherwise(F.least(other, shorter)).alias("best"))
    return found.where("k > 0").groupBy("id").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) of the written table ``links(id, root)``, each id once and never in a circle: the end of each chain."""
    while True:
        on = links.select(F.col("id").alias("root"), F.col("root").alias("far"))
        new = scratch.cut(links.join(on, "root", "left").select("id", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if not new.where("moved").limit(1).count():
            return new.drop("moved")
        scratch.free(links)
        links = new.drop("moved")
        links.scratch_path = new.scratch_path


def variants(spark: SparkSession, docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO, every: int = EVERY) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (doc_id, text; other columns don't matter).

    Null texts have no words; a null id counts as an empty one where runs are damaged; rows that repeat count each; of near
    words of equal number the least in code-point order is the form. Texts and words may be of any length. An empty table
    gives no rows."""
    scratch = Scratch(spark, "spelling")
    words = scratch.cut(vocabulary(docs, least_chars, least_count, every).orderBy("word").withColumn("id", F.monotonically_increasing_id()))
    best = scratch.cut(words.select("id", "n").join(near(words), "id", "left").select("id", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.id")).alias("form_id")))
    links = scratch.cut(best.where("form_id is not null").select("id", F.col("form_id").alias("root")))
    ends = roots(links, scratch).withColumnRenamed("root", "root_id")
    out = words.select("id", "word").join(best, "id").join(ends, "id", "left")
    out = out.join(words.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n")), "form_id", "left")
    out = out.join(words.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: CRC-32 by its table, over the bytes of id and run; deletions by place; forms followed one step at a time.
SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) AS r(i))
), found AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), lowered AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM found WHERE length(run) >= 6 GROUP BY ALL
), bytes AS (
    SELECT run, k, hex(encode(doc || ':' || run)) AS x FROM lowered
), hashed AS (
    SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h
    FROM bytes, crc
), words AS (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(k) >= 5
), cut AS (
    SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
    SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION
    SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.rest
    UNION
    SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest
), near AS (
    SELECT p.word, count(*) AS n_near, min({'less': -w.n, 'word': w.word}) AS best FROM pairs p JOIN words w ON w.word = p.other GROUP BY p.word
), forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * w.n THEN best.word END AS form, CASE WHEN -best.less >= 5 * w.n THEN -best.less END AS form_n FROM words w LEFT JOIN near USING (word)
), walk AS (
    SELECT word, word AS root FROM forms
    UNION ALL
    SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word JOIN forms e ON e.word = w.root AND e.form IS NULL
"""
