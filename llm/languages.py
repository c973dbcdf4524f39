"""Language identification in two steps: the family first, then the language within it.

A text is the shares of its letter sequences: of one to four bytes within a word, its ends marked, lower-cased as far as
Latin-1 goes, hashed into BUCKETS. Families are learnt too: languages are merged by the likeness of their mean shares
(average linkage), down to about the root of their number. Linear support vector machines, one for each family against the
others, choose the family; within it, one for each pair of its languages, which vote. Machines are fitted by dual
coordinate descent, each in a task of its own, on a bounded sample: at most ``per_lang`` rows of a language and
``most_rows`` in all, with texts of up to ``most_bytes``. All other work runs over every row and whole texts.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _vec
from ._scratch import Scratch, small_batches
from .toxicity import held_out

BUCKETS, LONGEST = 1 << 16, 4
PER_LANG, MOST_ROWS, MOST_BYTES = 1500, 24_000, 1 << 16
UNKNOWN = "und"
_SPACE = np.uint8(32)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def grams(column: pa.Array):
    """(row, bucket) of the letter sequences of a slice of texts, a pair of arrays for each length."""
    data, offsets = _vec.string_parts(column)
    n = len(offsets) - 1
    if not len(data):
        return
    low = np.where(_LETTER[data], _vec._LOWER[data], _SPACE)
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[upper] += 32
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    open_ = low != _SPACE
    first = np.ones(len(low), bool)  # a space stays only where it is the first after a letter, and each text ends with one
    first[1:] = open_[:-1]
    edge = np.zeros(len(low), bool)
    edge[offsets[1:][np.diff(offsets) > 0] - 1] = True
    keep = open_ | first
    times = keep.astype(np.int8) + (edge & open_)
    low, row, extra = np.repeat(low, times), np.repeat(row, times), np.repeat(edge & open_, times)
    last = np.flatnonzero(extra)[1::2]
    low[last] = _SPACE
    low, row = np.concatenate(([_SPACE], low)), np.concatenate((row[:1], row)) if len(row) else row
    if not len(row):
        return
    space = low == _SPACE
    code = np.zeros(len(low), np.uint64)
    for k in range(LONGEST):
        m = len(low) - k
        if m <= 0:
            return
        code = code[:m] | low[k:].astype(np.uint64) << np.uint64(8 * k)
        if k == 0:
            good = ~space
        else:  # spaces at the ends only, and not at both ends of nothing
            good = np.ones(m, bool) if k > 1 else ~(space[:m] & space[1:])
            for j in range(1, k):
                good &= ~space[j : j + m]
        at = np.flatnonzero(good)
        owner = np.where(space[at], row[np.minimum(at + 1, len(row) - 1)], row[at])
        yield owner, (_vec.mix(code[at] + np.uint64((k + 1) << 56)) % np.uint64(BUCKETS)).astype(np.int32)


def shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted buckets, their shares) of one text."""
    found = [b for _, b in grams(pa.array([text], pa.string()))]
    if not found or not sum(map(len, found)):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    buckets, n = np.unique(np.concatenate(found), return_counts=True)
    return buckets.astype(np.int32), (n / n.sum()).astype(np.float32)


def machine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 3.0, epochs: int = 12, seed: int = 11) -> np.ndarray:
    """Weights of a linear support vector machine (the last is the bias), by dual coordinate descent. Both sides weigh alike,
    however many rows they have; rows are scaled to a mean square of 1."""
    norm = np.array([float(v @ v) for _, v in rows])
    scale = 1 / np.sqrt(max(float(norm.mean()), 1e-12)) if len(rows) else 1.0
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    square = norm * scale**2 + 1.0
    most = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    xs = [(b, v.astype(float) * scale) for b, v in rows]
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            b, v = xs[i]
            slope = y[i] * (w[b] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[b] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(w * scale, bias).astype(np.float32)


def families(centres: np.ndarray, number: int) -> list[int]:
    """The family (its least member) of each language, by average linkage of the cosines between mean shares (square roots,
    less what all languages have in common)."""
    x = np.sqrt(centres)
    x = x - x.mean(0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    like, groups = x @ x.T, [[i] for i in range(len(x))]
    while len(groups) > number:
        pairs = [(-like[np.ix_(a, b)].mean(), i, i + 1 + j) for i, a in enumerate(groups) for j, b in enumerate(groups[i + 1 :])]
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)
    out = [0] * len(x)
    for g in groups:
        for i in g:
            out[i] = min(g)
    return out


class Tree:
    """Languages, the family of each, and the machines: weights[("family", f)] and weights[(i, j)], i before j."""

    def __init__(self, names: list[str], family: list[int], weights: dict):
        self.names, self.family = names, family
        self.roots = sorted(set(family))
        self.members = {f: [i for i, g in enumerate(family) if g == f] for f in self.roots}
        self.parts = {}
        if len(self.roots) > 1:
            self.parts["family"] = np.stack([weights["family", f] for f in self.roots], 1)
        for f, m in self.members.items():
            if len(m) > 1:
                self.parts[f] = np.stack([weights[p] for p in itertools.combinations(m, 2)], 1)

    def margins(self, part, found, n: int, rows: np.ndarray) -> np.ndarray:
        """Scores of the machines of one part for the given rows of a slice."""
        w = self.parts[part]
        on = np.full(n, -1, np.int64)
        on[rows] = np.arange(len(rows))
        total, count = np.zeros((len(rows), w.shape[1])), np.zeros(len(rows))
        for owner, bucket in found:
            owner = on[owner]
            here = owner >= 0
            owner, bucket = owner[here], bucket[here]
            count += np.bincount(owner, minlength=len(rows))
            for c in range(w.shape[1]):
                total[:, c] += np.bincount(owner, w[bucket, c], minlength=len(rows))
        return total / np.maximum(count, 1)[:, None] + w[-1]

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, score) of each text. The score is the family's share of the sigmoids of all families,
        times the mean sigmoid of the language's margins within it."""
        which, score = np.zeros(len(column), np.int64), np.ones(len(column))
        for a, b in _vec.slices(column):
            n, found = b - a, list(grams(column[a:b]))
            chosen, sure = np.full(n, self.roots[0]), np.ones(n)
            if len(self.roots) > 1:
                p = _sigmoid(self.margins("family", found, n, np.arange(n)))
                chosen, sure = np.array(self.roots)[p.argmax(1)], p.max(1) / p.sum(1)
            for f, members in self.members.items():
                rows = np.flatnonzero(chosen == f)
                best, part = np.full(len(rows), members[0]), np.ones(len(rows))
                if len(members) > 1 and len(rows):
                    p = _sigmoid(self.margins(f, found, n, rows))
                    votes, strength = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
                    for c, (i, j) in enumerate(itertools.combinations(range(len(members)), 2)):
                        votes[:, i] += p[:, c] >= 0.5
                        votes[:, j] += p[:, c] < 0.5
                        strength[:, i] += p[:, c]
                        strength[:, j] += 1 - p[:, c]
                    strength /= len(members) - 1
                    top = (votes + strength / 2).argmax(1)
                    best, part = np.array(members)[top], strength[np.arange(len(rows)), top]
                which[a + rows], score[a + rows] = best, sure[rows] * part
        return which, score


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(3 * z, -40, 40)))


def _share_map(batches):
    for batch in batches:
        found = [shares(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())], ["lang", "buckets", "shares"])


def sample(docs: DataFrame, per_lang: int = PER_LANG, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(lang, text) of the rows learnt from: not held out, with lang, id and text, the first of each language by hash. An id
    that repeats counts once. What doesn't come near the first is left out before anything is moved."""
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id is not null and lang is not null").where(~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    per = max(1, min(per_lang, most_rows // max(1, len(counts))))
    hashed = F.xxhash64("doc_id")
    bound = F.lit(None).cast("double")
    if counts:
        shares = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, 2.0 * per / n))) for k, n in counts.items()))
        bound = shares[F.col("lang")]
    near = rows.where((hashed.cast("double") / 2.0**64 + 0.5) <= bound).where(F.octet_length("text").between(1, most_bytes))
    near = near.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(hashed, "doc_id"))
    return near.withColumn("place", place).where(F.col("place") <= per).select("lang", "text")


def _problem_map(frame: pd.DataFrame) -> pd.DataFrame:
    """One machine, from all rows of a problem; their order is made the table's own."""
    frame = frame.sort_values(["side", "buckets", "shares"], kind="stable")
    rows = [(np.frombuffer(b, np.int32), np.frombuffer(s, np.float32)) for b, s in zip(frame["buckets"], frame["shares"])]
    w = machine(rows, frame["side"].to_numpy(float))
    return pd.DataFrame({"problem": frame["problem"].iloc[:1], "weights": [w.tobytes()]})


def learn(spark: SparkSession, docs: DataFrame, per_lang: int = PER_LANG, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, number: int | None = None) -> Tree | None:
    """The fitted tree; ``number`` of families, else the rounded root of the number of languages. None without rows."""
    scratch = Scratch(spark, "languages")
    rows = scratch.cut(sample(docs, per_lang, most_rows, most_bytes).mapInArrow(_share_map, "lang string, buckets binary, shares binary").where(F.octet_length("buckets") > 0))

    def centre(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS)
        for b, s in zip(frame["buckets"], frame["shares"]):
            total[np.frombuffer(b, np.int32)] += np.frombuffer(s, np.float32)
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "centre": [(total / len(frame)).astype(np.float32).tobytes()]})

    centres = sorted((r.lang, r.centre) for r in rows.groupBy("lang").applyInPandas(centre, "lang string, centre binary").collect())
    if not centres:
        return None
    names = [c[0] for c in centres]
    family = families(np.stack([np.frombuffer(c[1], np.float32) for c in centres]).astype(float), number or round(len(names) ** 0.5))
    problems, wanted = [], []
    if len(set(family)) > 1:
        for f in sorted(set(family)):
            wanted.append(("family", f))
            problems += [(len(wanted) - 1, lang, 1 if g == f else -1) for lang, g in zip(names, family)]
    for f in sorted(set(family)):
        for i, j in itertools.combinations([k for k, g in enumerate(family) if g == f], 2):
            wanted.append((i, j))
            problems += [(len(wanted) - 1, names[i], 1), (len(wanted) - 1, names[j], -1)]
    weights = {}
    if wanted:
        table = spark.createDataFrame(problems, "problem int, lang string, side int")  # languages by problems
        fitted = rows.join(F.broadcast(table), "lang").groupBy("problem").applyInPandas(_problem_map, "problem int, weights binary").collect()
        weights = {wanted[r.problem]: np.frombuffer(r.weights, np.float32) for r in fitted}
    scratch.free(rows)
    return Tree(names, family, weights)


def identify(spark: SparkSession, docs: DataFrame, tree: Tree | None) -> DataFrame:
    """``docs`` with lang_pred (string) and lang_score (double, 0 to 1), which replace columns of these names.

    Whole texts are read. Null texts and texts without a letter get ``und``, with score 1, as do all where nothing could be
    learnt, with score 0; one language learnt is always the answer. Each row is worked out by its text alone, so rows that
    repeat and rows without an id are like others; an empty table gives no rows."""
    small_batches(spark)
    text = F.col("text").cast("string")
    none = text.isNull() | ~text.rlike(r"\p{L}")
    if tree is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "lang_score": F.when(none, 1.0).otherwise(0.0)})
    held = spark.sparkContext.broadcast(tree)

    @F.arrow_udf("struct<lang:string,score:double>")
    def found(text: pa.Array) -> pa.Array:
        which, score = held.value.predict(text)
        return pa.StructArray.from_arrays([pa.array(held.value.names, pa.string()).take(pa.array(which)), pa.array(score)], ["lang", "score"])

    out = docs.withColumn("lang_found", found.asNondeterministic()(text))  # once a row, whatever reads its fields
    out = out.withColumns({"lang_pred": F.when(none, UNKNOWN).otherwise(F.col("lang_found.lang")), "lang_score": F.when(none, 1.0).otherwise(F.col("lang_found.score"))})
    return out.drop("lang_found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(spark, docs.select("doc_id", "text"), learn(spark, docs.select("doc_id", "lang", "text")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
