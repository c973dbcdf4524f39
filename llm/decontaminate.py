"""Benchmark decontamination by latent semantic retrieval.

Terms (words of letters and digits, lower-cased) are hashed into TERMS columns. Two passes over all documents fit the
latent space: document frequencies of terms over passages, then the range sketch of a randomised SVD (Y = A Omega,
B = A' Y) of the TF-IDF matrix of passages, summed over tasks. The third pass projects every block of BLOCK words,
slides windows as long as each benchmark item over the blocks, and takes those near it in cosine as candidates. Each
candidate is checked by its longest common subsequence with the item, and, where that alone doesn't decide, by the
item's answer standing in it whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec
from ._scratch import Scratch

TERMS, SKETCH, BLOCK, PASSAGE = 1 << 13, 48, 8, 32
#: Benchmark items searched in one round over the documents (more go in further rounds), and held against windows at once.
ITEMS, AT_ONCE = 4096, 512


def _blocks(first: np.ndarray, size: int):
    """Starts of the blocks of ``size`` words of each text, and the first block of each text and the total."""
    count = np.diff(first)
    n = -(-count // size)
    at = np.concatenate(([0], np.cumsum(n)))
    start = np.repeat(first[:-1], n) + size * (np.arange(at[-1]) - np.repeat(at[:-1], n))
    return start, at


def _df_map(batches):
    total = np.zeros(TERMS + 1, np.int64)
    for batch in batches:
        for a, b in _vec.slices(batch.column("text")):
            h, first, _, _ = _vec.words(batch.column("text")[a:b], alnum=True)
            if len(h):
                start, _ = _blocks(first, PASSAGE)
                who = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
                key = np.sort(who.astype(np.int32) * np.int32(TERMS) + (h & np.uint64(TERMS - 1)).astype(np.int32))
                key = key[np.concatenate(([True], key[1:] != key[:-1]))]
                total[:TERMS] += np.bincount(key & (TERMS - 1), minlength=TERMS)
                total[TERMS] += len(start)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "df"])


def _signs() -> tuple[np.ndarray, np.ndarray]:
    """The sparse random test matrix: each term's one column and its sign."""
    rng = np.random.Generator(np.random.PCG64(11))
    return rng.integers(0, SKETCH, TERMS), rng.choice([-1.0, 1.0], TERMS)


def _sketch_map(weight: np.ndarray, parts: int):
    def run(batches):
        column, sign = _signs()
        signed = sign * weight
        out = np.zeros((TERMS, SKETCH), np.float32)
        for batch in batches:
            for a, b in _vec.slices(batch.column("text"), 1 << 20):
                h, first, _, _ = _vec.words(batch.column("text")[a:b], alnum=True)
                if not len(h):
                    continue
                start, _ = _blocks(first, PASSAGE)
                t = (h & np.uint64(TERMS - 1)).astype(np.int64)
                norm = np.add.reduceat(weight[t] ** 2, start)
                who = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
                y = np.bincount(who * SKETCH + column[t], signed[t], minlength=len(start) * SKETCH).reshape(-1, SKETCH).astype(np.float32)
                y /= np.maximum(norm, 1e-9)[:, None]  # both factors of A'A are scaled by the passage's norm
                order = np.argsort(t.astype(np.uint16), kind="stable")  # a radix sort
                ts = t[order]
                at = np.flatnonzero(np.concatenate(([True], ts[1:] != ts[:-1])))
                out[ts[at]] += np.add.reduceat(y[who[order]], at, axis=0) * weight[ts[at], None]
        step = TERMS // parts
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array([out[i * step : (i + 1) * step].tobytes() for i in range(parts)], pa.binary())], ["part", "sums"])

    return run


def _add_map(batches):
    """Sums of the sketch's parts within a task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, s in zip(batch.column("part").to_pylist(), batch.column("sums")):
            x = np.frombuffer(s.as_py(), np.float32)
            total[p] = total[p] + x if p in total else x.astype(np.float64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["part", "sums"])


def latent_space(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> np.ndarray:
    """TERMS x SKETCH projection, IDF included. What comes to the driver has the size of the sketch, whatever the input."""
    df = docs.mapInArrow(_df_map, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    count = np.zeros(TERMS + 1)
    for r in df:
        count[r[0]] = r[1]
    weight = np.log1p(count[TERMS] / np.maximum(count[:TERMS], 1)).astype(np.float32)
    if not count[TERMS]:
        return np.zeros((TERMS, SKETCH), np.float32)
    parts = 32
    sums = docs.mapInArrow(_sketch_map(weight, parts), "part int, sums binary")
    fan = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # two levels: tasks' sums meet by (part, salt), then by part
    level = sums.withColumn("salt", F.spark_partition_id() % 8).repartition(fan, "part", "salt").mapInArrow(_add_map, "part int, sums binary")
    rows = level.repartition(min(fan, parts), "part").mapInArrow(_add_map, "part int, sums binary").collect()
    b = np.concatenate([np.frombuffer(r[1], np.float32) for r in sorted(rows)]).reshape(TERMS, SKETCH).astype(np.float64)
    column, sign = _signs()
    core = np.zeros((SKETCH, SKETCH))
    np.add.at(core, column, sign[:, None] * b)
    value, vector = np.linalg.eigh((core + core.T) / 2)
    ok = value > 1e-9 * max(value.max(), 1e-30)
    left, singular, _ = np.linalg.svd(b @ (vector[:, ok] / np.sqrt(value[ok])), full_matrices=False)
    return projection(left, singular, weight)


def projection(left, singular, weight) -> np.ndarray:
    """All directions found, scaled to equal spread: the first ones tell languages and frequent words, which all texts of a
    language share, and would rule the cosine if each had its own weight. The same for any number of directions."""
    basis = np.zeros((TERMS, SKETCH), np.float32)
    n = min(SKETCH, left.shape[1])
    basis[:, :n] = left[:, :n] / np.maximum(singular[:n], 1e-9 * singular[:1])
    return basis * weight[:, None]


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit per word of ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _holds(part: list[int], b: list[int]) -> bool:
    n, at = len(part), -1
    while n:
        try:
            at = b.index(part[0], at + 1, len(b) - n + 1)
        except ValueError:
            break
        if b[at : at + n] == part:
            return True
    return False


class Items:
    """Benchmark items in the latent space: their words, answers and window lengths in blocks."""

    def __init__(self, rows, space: np.ndarray):
        self.ids, self.words, self.answers, vec = [], [], [], []
        for item, text, answer in rows:
            h, _, _, _ = _vec.words(pa.array([text or ""]), alnum=True)
            if not len(h):
                continue
            if not answer:  # without an answer column the last sentence is the answer
                answer = [s for s in (text or "").replace("!", ".").replace("?", ".").split(".") if s.strip()][-1:]
                answer = answer[0] if answer else ""
            self.ids.append(item)
            self.words.append(h.tolist())
            self.answers.append(_vec.words(pa.array([answer]), alnum=True)[0].tolist())
            v = space[(h & np.uint64(TERMS - 1)).astype(np.int64)].sum(0)
            vec.append(v / max(float(np.linalg.norm(v)), 1e-12))
        self.vec = np.array(vec, np.float32).reshape(-1, SKETCH)
        self.terms = np.zeros((len(self.words), TERMS), bool)
        for i, w in enumerate(self.words):
            self.terms[i, (np.array(w, np.uint64) & np.uint64(TERMS - 1)).astype(np.int64)] = True
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.span = np.array([max(1, -(-len(w) // BLOCK)) for w in self.words], np.int64)

    def answered(self, k: int, body: list[int]) -> bool:
        """Whether an item's answer, of three words at least, stands whole among some words."""
        return len(self.answers[k]) >= 3 and _holds(self.answers[k], body)


def _block_sums(space: np.ndarray, t: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The sum of the terms' vectors in each block, word by word of all blocks at once, so that little is in use."""
    end = np.append(start[1:], len(t))
    out = np.zeros((len(start), space.shape[1]), np.float32)
    for k in range(BLOCK):
        at = start + k
        if k and not (ok := at < end).all():
            rows = np.flatnonzero(ok)
            out[rows] += space[t[at[rows]]]
        else:
            out += space[t[at]]
    return out


def _search_map(space: np.ndarray, items: Items, cosine: float, share: float, share_with_answer: float):
    def run(batches):
        for batch in batches:
            out = []
            ids = batch.column("doc_id").to_pylist()
            for a, b in _vec.slices(batch.column("text"), 1 << 20):
                h, first, _, _ = _vec.words(batch.column("text")[a:b], alnum=True)
                if not len(h):
                    continue
                start, at = _blocks(first, BLOCK)
                t = (h & np.uint64(TERMS - 1)).astype(np.int64)
                e = _block_sums(space, t, start)
                home = np.repeat(np.arange(b - a), np.diff(at))
                last = at[home + 1]
                place = np.arange(len(start))
                # windows of 1, 2, ... blocks as running sums; empty blocks behind each text keep its windows its own
                gap = int(items.span.max()) - 1
                there = place + gap * home
                each = np.zeros((len(start) + gap * (b - a), SKETCH), np.float32)
                each[there] = e
                window, wide = each.copy(), 1
                block_of = np.empty(len(each), np.int64)
                for n in np.unique(items.span).tolist():
                    own = np.flatnonzero(items.span == n)
                    while wide < n:
                        window[:-wide] += each[wide:]
                        wide += 1
                    fit = (place + n <= last) | (place == at[home])
                    block_of.fill(-1)
                    block_of[there[fit]] = place[fit]
                    length = np.sqrt(np.einsum("nd,nd->n", window, window))
                    least = cosine * min(1.0, 0.7 + 0.05 * n)  # few blocks are never well aligned
                    bound = least * np.maximum(length, 1e-9)[:, None]
                    parts = [np.nonzero(window @ items.vec[own[k : k + AT_ONCE]].T >= bound) for k in range(0, len(own), AT_ONCE)]
                    near = block_of[np.concatenate([p[0] for p in parts])]
                    which = np.concatenate([p[1] + k * AT_ONCE for k, p in enumerate(parts)])
                    near, which = near[near >= 0], which[near >= 0]
                    if not len(near):
                        continue
                    block = near
                    # no more words than the item's own that stand in the window can be common to both in order
                    lo = np.maximum(first[home[block]], start[block] - BLOCK)
                    hi = np.minimum(first[home[block] + 1], start[block] + (n + 1) * BLOCK)
                    words = np.repeat(own[which], hi - lo)
                    at_word = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(len(words))
                    shared = np.add.reduceat(items.terms[words, t[at_word]], np.cumsum(hi - lo) - (hi - lo), dtype=np.int64)
                    able = shared >= min(share, share_with_answer) * items.length[own[which]]
                    which, block = which[able], block[able]
                    order = np.lexsort((block, which, home[block]))
                    group: list[list[int]] = []
                    for i in order.tolist():
                        d, k, p = int(home[block[i]]), int(own[which[i]]), int(block[i])
                        if group and group[-1][0] == d and group[-1][1] == k and p <= group[-1][3]:
                            group[-1][3] = p + int(n)
                        else:
                            group.append([d, k, p, p + int(n)])
                    for d, k, p, q in group:
                        lo = max(int(first[d]), int(start[p]) - BLOCK)
                        hi = min(int(first[d + 1]), int(start[p]) + (q - p + 1) * BLOCK)
                        body, item = h[lo:hi].tolist(), items.words[k]
                        answer = None
                        if int(items.terms[k, t[lo:hi]].sum()) < share * len(item):  # too few words for the larger share
                            answer = items.answered(k, body)
                            if not answer:
                                continue
                        got = lcs(item, body) / len(item)
                        answer = got >= share_with_answer and (items.answered(k, body) if answer is None else answer)
                        if got >= share or answer:
                            out.append((ids[a + d], items.ids[k], got, answer, lo - int(first[d])))
            best: dict[tuple, tuple] = {}
            for row in out:
                if (key := row[:2]) not in best or row[2] > best[key][2]:
                    best[key] = row
            cols = list(zip(*best.values())) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64()))], ["doc_id", "item_id", "lcs_share", "has_answer", "word_at"])

    return run


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, cosine: float = 0.6, share: float = 0.7, share_with_answer: float = 0.5) -> DataFrame:
    """(doc_id, item_id, lcs_share, has_answer, word_at): the documents that hold a benchmark item, or its paraphrase.

    ``benchmark`` has item_id and text, and may have answer; ITEMS items are held by a task at once and more are
    searched in rounds. Null, empty and wordless texts and items match nothing; items are found anywhere in texts of
    any length. An id with several rows is found by any of them, once for a document: ties between equal shares go to the
    hit with the answer, then to the later place. Rows that repeat a doc_id are one document here; hits of rows with a null
    id have a null id. Other columns play no part; empty tables give no hits."""
    scratch = Scratch(spark, "decontaminate")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    space = latent_space(spark, docs, scratch)
    bench = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"), (F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")).alias("answer")).where("item_id is not null")
    bench = bench.where("text is not null").distinct().select(F.struct("item_id", "text", F.coalesce("answer", F.lit("")).alias("answer")).alias("row"))
    out, last = None, None
    while True:
        rows = [r.row for r in (bench if last is None else bench.where(F.col("row") > F.struct(*(F.lit(x).alias(c) for c, x in zip(("item_id", "text", "answer"), last))))).orderBy("row").limit(ITEMS).collect()]
        if not rows and out is not None:
            break
        shared = spark.sparkContext.broadcast((space, Items([tuple(r) for r in rows], space)))
        hits = docs.mapInArrow(_with(shared, cosine, share, share_with_answer), "doc_id long, item_id long, lcs_share double, has_answer boolean, word_at long")
        out = hits if out is None else out.union(hits)
        if len(rows) < ITEMS:
            break
        last = tuple(rows[-1])
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs_share", "has_answer", "word_at")).alias("x")).select("doc_id", "item_id", "x.lcs_share", "x.has_answer", "x.word_at")


def _with(shared, cosine, share, share_with_answer):
    def run(batches):
        space, items = shared.value
        if len(items.ids):
            yield from _search_map(space, items, cosine, share, share_with_answer)(batches)

    return run


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item; a row with a null id goes only if another null one is hit."""
    bad = contaminated(spark, docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(spark, docs, bench)
