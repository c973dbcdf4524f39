"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and the first 4, 5 and 6 bytes of each (A-Z lower-cased), hashed into 2^20 buckets; a
text has the set of its buckets. The classifier is fitted on a bounded sample of labelled rows (``per_class`` rows of
each label and ``most_bytes`` of their texts, the first in hash order); everything else runs over all rows. The model
holds a weight and ``rank`` factors per bucket: pairs of terms add or take away what a sum of weights cannot say.

It is fitted twice. The first fit has all buckets of the sample, none left out. Buckets that matter stay for the second
one: those that tell the labels apart by themselves (chi-square), and those whose pairs with others do so on rows that
the first fit hasn't seen, whatever they say by themselves (the gain in likelihood). Other buckets carry no weight, so
that the length of a text adds no noise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec
from ._scratch import small_batches

BUCKETS, RANK = 1 << 20, 4


def terms(column: pa.Array):
    """The sorted distinct buckets of each text."""
    for a, b in _vec.slices(column):
        part = column[a:b]
        h, first, begin, end = _vec.words(part, alnum=True)
        data, _ = _vec.string_parts(part)
        low = _vec._LOWER[data]
        size = end - begin
        code = np.zeros(len(begin), np.uint64)
        hashed, place = [h % np.uint64(BUCKETS)], [np.arange(len(h))]
        for k in range(6):
            on = size > k
            code[on] |= low[begin[on] + k].astype(np.uint64) << np.uint64(8 * k)
            if k >= 3:
                at = np.flatnonzero(on)
                hashed.append(_vec.mix(code[at] + np.uint64((k + 1) << 56)) % np.uint64(BUCKETS))
                place.append(at)
        doc = np.repeat(np.arange(b - a), np.diff(first))
        key = np.concatenate([(doc[p].astype(np.int64) << 20) | x.astype(np.int64) for x, p in zip(hashed, place)])
        key = np.unique(key)
        cut = np.searchsorted(key, np.arange(b - a + 1, dtype=np.int64) << 20)
        bucket = (key & (BUCKETS - 1)).astype(np.int32)
        for i in range(b - a):
            yield bucket[cut[i] : cut[i + 1]]


class Machine:
    """Weights and factors of the chosen buckets; all other buckets weigh nothing."""

    def __init__(self, chosen, w, v, bias):
        self.chosen, self.w, self.v, self.bias, self.slot = chosen, w, v, bias, np.full(BUCKETS, -1, np.int32)
        self.slot[chosen] = np.arange(len(chosen))

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for i, x in enumerate(terms(column)):
            s = self.slot[x]
            s = s[s >= 0]
            z = self.bias
            if len(s):
                v = self.v[s]
                z += self.w[s].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
            out[i] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


class _Flat:
    """Texts as one array of term numbers, from which those of any batch are cut."""

    def __init__(self, rows: list[np.ndarray]):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.at = np.cumsum(self.size) - self.size
        flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)
        there = np.bincount(flat, minlength=BUCKETS) > 0
        self.names = np.flatnonzero(there)
        self.flat = (np.cumsum(there) - 1).astype(np.int32)[flat]

    def batch(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the batch, term) of all terms of some texts."""
        n = self.size[which]
        return np.repeat(np.arange(len(which)), n), self.flat[np.repeat(self.at[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _sums(doc, v, n):
    """Sums of factors by text, and the pairs' part of the score."""
    total = np.stack([np.bincount(doc, v[:, f], minlength=n) for f in range(v.shape[1])], 1)
    return total, 0.5 * ((total**2).sum(1) - np.bincount(doc, (v**2).sum(1), minlength=n))


def pair_gains(rows: list[np.ndarray], y: np.ndarray, rank: int = RANK, epochs: int = 8, rate: float = 0.1, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, gains): how much the pairs of each bucket raise the log-likelihood of every fourth row, after a fit on the
    others with all buckets. Weights shrink by what chance alone would give them, factors hardly (AdaGrad, by batches)."""
    x, n = _Flat(rows), len(y)
    test = np.arange(n) % 4 == 3
    train, test = np.flatnonzero(~test), np.flatnonzero(test)
    size, rng = len(x.names), np.random.Generator(np.random.PCG64(seed))
    w, v, bias = np.zeros(size), rng.normal(0, 0.01, (size, rank)), 0.0
    gw, gv, gb = np.full(size, 1e-4), np.full((size, rank), 1e-4), 1e-4
    chance = 1.5 * np.sqrt(np.bincount(x.flat, minlength=size)) / n
    for _ in range(epochs):
        rng.shuffle(train)
        for k in range(0, len(train), 256):
            part = train[k : k + 256]
            doc, term = x.batch(part)
            used, term = np.unique(term, return_inverse=True)
            vt = v[used][term]
            total, pairs = _sums(doc, vt, len(part))
            z = bias + np.bincount(doc, w[used][term], minlength=len(part)) + pairs
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]) / len(part)
            dw = np.bincount(term, g[doc], minlength=len(used))
            dv = g[doc][:, None] * (total[doc] - vt)
            dv = np.stack([np.bincount(term, dv[:, f], minlength=len(used)) for f in range(rank)], 1) + 1e-4 * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += g.sum() ** 2
            step = rate / np.sqrt(gw[used])
            new = w[used] - step * dw
            w[used] = np.sign(new) * np.maximum(np.abs(new) - step * chance[used], 0)
            v[used] -= rate * dv / np.sqrt(gv[used])
            bias -= rate * g.sum() / np.sqrt(gb)
    gain = np.zeros(size)
    for k in range(0, len(test), 256):
        part = test[k : k + 256]
        doc, term = x.batch(part)
        total, pairs = _sums(doc, v[term], len(part))
        z = (bias + np.bincount(doc, w[term], minlength=len(part)) + pairs)[doc]
        own = (v[term] * (total[doc] - v[term])).sum(1)
        sign = np.where(y[part][doc] > 0, -1.0, 1.0)
        np.add.at(gain, term, np.logaddexp(0, sign * (z - own)) - np.logaddexp(0, sign * z))
    return x.names.astype(np.int64), gain


def fit(rows: list[np.ndarray], y: np.ndarray, share: float, rank: int = RANK, least_chi: float = 12.0, least_gain: float = 0.03, epochs: int = 60, seed: int = 7) -> Machine:
    """Logistic loss with Adam on the buckets that matter; ``share``: the share of label 1 among all labelled rows, as the
    sample is balanced. ``least_gain`` is by row that the gain is measured on, 6 in all at least."""
    n, n1 = len(y), int(y.sum())
    if not n or n1 in (0, n):
        return Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, rank)), -4.0 if not n1 else 4.0)
    c1 = np.bincount(np.concatenate([r for r, t in zip(rows, y) if t]), minlength=BUCKETS).astype(float)
    c = np.bincount(np.concatenate(rows), minlength=BUCKETS).astype(float)
    expected = c * n1 / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where((c > 0) & (c < n), (c1 - expected) ** 2 * n * n / (c * (n - c) * (n1 / n) * (1 - n1 / n) * n), 0.0)
    named, gain = pair_gains(rows, y, rank, seed=seed)
    chosen = np.union1d(np.flatnonzero(chi >= least_chi), named[gain >= max(6.0, least_gain * (n // 4))])
    slot = np.full(BUCKETS, -1, np.int64)
    slot[chosen] = np.arange(len(chosen))
    xs = [slot[r][slot[r] >= 0] for r in rows]
    rng = np.random.Generator(np.random.PCG64(seed))
    w, v, bias = np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), rank)), 0.0
    state = {k: [np.zeros_like(p), np.zeros_like(p)] for k, p in (("w", w), ("v", v))}
    state_b, step = [0.0, 0.0], 0
    sizes = np.array([len(x) for x in xs])
    order = np.arange(n)
    for _ in range(epochs if len(chosen) else 0):
        rng.shuffle(order)
        for k in range(0, n, 256):
            batch = order[k : k + 256]
            idx = np.concatenate([xs[i] for i in batch]) if sizes[batch].sum() else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(batch)), sizes[batch])
            lin = np.bincount(doc, w[idx], minlength=len(batch))
            total = np.stack([np.bincount(doc, v[idx, f], minlength=len(batch)) for f in range(rank)], 1)
            square = np.bincount(doc, (v[idx] ** 2).sum(1), minlength=len(batch))
            z = bias + lin + 0.5 * ((total**2).sum(1) - square)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[batch]) / len(batch)
            gw = np.bincount(idx, g[doc], minlength=len(w)) + 1e-4 * w
            dv = g[doc][:, None] * (total[doc] - v[idx])
            gv = np.stack([np.bincount(idx, dv[:, f], minlength=len(w)) for f in range(rank)], 1) + 1e-3 * v
            step += 1
            for p, grad, name in ((w, gw, "w"), (v, gv, "v")):
                m1, m2 = state[name]
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad**2 - m2)
                p -= 0.02 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
            gb = g.sum()
            state_b[0] += 0.1 * (gb - state_b[0])
            state_b[1] += 0.01 * (gb**2 - state_b[1])
            bias -= 0.02 * (state_b[0] / (1 - 0.9**step)) / (np.sqrt(state_b[1] / (1 - 0.99**step)) + 1e-8)
    sample = n1 / n
    bias += np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - np.log(sample / (1 - sample))
    return Machine(chosen, w, v, float(bias))


def held_out(doc_id):
    """crc32 of the id as text, mod 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = 4000, most_bytes: int = 64 << 20) -> Machine:
    """Fit on at most ``per_class`` labelled rows of each label that are not held out, and of these on as many as have texts of
    ``most_bytes`` in all; both in hash order. An id that repeats counts once, with the text of least hash."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    picked = [marks.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for t in (0, 1)]
    schema = "doc_id long, toxic int"
    ids = {r[0]: (i, r[1]) for p in picked for i, r in enumerate(p.collect())}

    def texts(wanted) -> DataFrame:
        few = spark.createDataFrame(wanted, schema)  # at most 2 * per_class rows
        both = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(few), "doc_id")
        return both.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    size = texts([(d, t) for d, (_, t) in ids.items()]).select("doc_id", "toxic", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()
    wanted, room = [], {0: most_bytes, 1: most_bytes}
    for r in sorted(size, key=lambda r: ids[r.doc_id][0]):
        room[r.toxic] -= r.n
        if room[r.toxic] >= 0:
            wanted.append((r.doc_id, r.toxic))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([t.tobytes() for t in terms(batch.column("text"))], pa.binary())], ["toxic", "terms"])

    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    sample = texts(wanted).mapInArrow(run, "toxic int, terms binary")
    got = sample.repartition(1).mapInArrow(_fit_map(share), "chosen binary, w binary, v binary, bias double").collect()  # the sample is bounded, so one task holds it
    if not got:
        return fit([], np.zeros(0), share)
    chosen, w, v, bias = got[0]
    return Machine(np.frombuffer(chosen, np.int64), np.frombuffer(w), np.frombuffer(v).reshape(-1, RANK), bias)


def _fit_map(share: float):
    """The fit, in a worker, as its arrays are no load for the driver."""

    def run(batches):
        got = [(t, x.as_buffer().to_pybytes()) for batch in batches for t, x in zip(batch.column("toxic").to_pylist(), batch.column("terms"))]
        if not got:
            return
        got.sort()
        order = np.random.Generator(np.random.PCG64(len(got))).permutation(len(got))
        m = fit([np.frombuffer(got[i][1], np.int32) for i in order], np.array([got[i][0] for i in order], float), share)
        arrays = (np.ascontiguousarray(x, t).tobytes() for x, t in ((m.chosen, np.int64), (m.w, float), (m.v, float)))
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in arrays), pa.array([m.bias])], ["chosen", "w", "v", "bias"])

    return run


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> DataFrame:
    """``docs`` with toxic_score (double, 0 to 1) and toxic_predicted (int, 1 from 0.5 on), which replace columns of these
    names; all other columns stay as they are.

    Whole texts are scored; null and empty texts get the score of a text without terms; rows with a null id are scored and
    never learnt from. Without labels of both kinds the score is that of the prevailing label. Repeated ids are scored row
    by row; an empty table gives an empty result."""
    small_batches(spark)
    machine = spark.sparkContext.broadcast(learn(spark, docs, labels, per_class))

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(machine.value.score(pa.array(text, pa.string(), from_pandas=True)))

    out = docs.withColumn("toxic_score", scored(F.col("text").cast("string")))
    return out.withColumn("toxic_predicted", (F.col("toxic_score") >= 0.5).cast("int"))


def reject(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with their own columns."""
    return score(spark, docs, labels).where("toxic_predicted = 0").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(spark, docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))
