"""Masked pseudo-likelihood: a bidirectional window network in numpy predicts each token from both sides.

Tokens are words by WORD_BITS bits of their hash: a fixed number of ids, so that what a task holds doesn't grow with the
corpus, and many more than a corpus of some GB has words, so that unlike words seldom share one. Words are put into
CLASSES classes by the company they keep: a document is the sum of random signs of its words, a word the mean of its
documents, and each of the AXES axes along which words differ most, weighted by how often they occur, gives one bit of
the class. So words of the same kind of text (a language, a genre) share classes. The network gives the probability of the
class: the mean of the embeddings of up to WINDOW tokens on each side, weighted by side and distance, a hidden layer, a
softmax over all classes. Within its class a word has its share of the corpus's tokens, counted exactly. The product is a
distribution over all ids.

Training goes over every position of every document once. Rows are dealt to groups by a hash of id and text, about
``group_rows`` each; a local model descends through a group's rows in order of id, and the groups' parameters are
averaged by their numbers of tokens in shuffled levels. So scores depend on the table alone, not on how it is split
into files or tasks. Scores sum the conditional log-probabilities of all tokens of a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec
from ._scratch import Scratch, small_batches

WORD_BITS, AXES, SKETCH, ROW_BITS, WIDTH, WINDOW = 24, 7, 8, 14, 16, 3
WORDS, CLASSES, ROWS = 1 << WORD_BITS, 1 << AXES, 1 << ROW_BITS
SHAPES = {"embed": (ROWS, WIDTH), "side": (2 * WINDOW, WIDTH), "hidden": (WIDTH, WIDTH), "hidden_bias": (WIDTH,), "out": (CLASSES, WIDTH), "out_bias": (CLASSES,)}
OFFSETS = [*range(-WINDOW, 0), *range(1, WINDOW + 1)]
#: Positions worked on at once, and bytes of a slice of texts.
STEP, SLICE = 8192, 1 << 20
#: Models that are averaged at once.
FAN = 32


def start(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    out = {k: np.zeros(s, np.float32) if k.startswith("out") or k == "hidden_bias" else (rng.standard_normal(s) * 0.3).astype(np.float32) for k, s in SHAPES.items()}
    out["side"] = np.ones(SHAPES["side"], np.float32)
    return out


def pack(model: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([model[k].ravel() for k in SHAPES]).astype(np.float32).tobytes()


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(raw, np.float32), {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).copy()
        at += n
    return out


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word ids, first token of each row and the total) of a slice of texts."""
    h, first, _, _ = _vec.words(column)
    return (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), first


def embed_rows(ids: np.ndarray) -> np.ndarray:
    return (ids & (ROWS - 1)).astype(np.uint16)


def _context(model, rows: np.ndarray, row: np.ndarray, a: int, b: int):
    """Mean of the weighted embeddings around positions [a, b), features first, and what a step back needs."""
    lo, hi = max(0, a - WINDOW), min(len(rows), b + WINDOW)
    e = np.ascontiguousarray(model["embed"][rows[lo:hi]].T)
    ctx, seen, parts = np.zeros((WIDTH, b - a), np.float32), np.zeros(b - a, np.float32), []
    for j, k in enumerate(OFFSETS):
        i, n = max(a, lo - k), min(b, hi - k)
        if i >= n:
            parts.append(None)
            continue
        ok = (row[i + k : n + k] == row[i:n]).astype(np.float32)  # a window ends where its text does
        here, there = slice(i - a, n - a), slice(i + k - lo, n + k - lo)
        near = e[:, there] * ok
        ctx[:, here] += model["side"][j][:, None] * near
        seen[here] += ok
        parts.append((here, there, ok, near))
    seen = 1 / np.maximum(seen, 1)
    ctx *= seen
    return ctx, seen, parts, lo, hi


def _forward(model, ctx):
    hid = np.tanh(model["hidden"].T @ ctx + model["hidden_bias"][:, None])
    p = np.exp(model["out"] @ hid + model["out_bias"][:, None])  # bounded: hidden values lie between -1 and 1
    return hid, p, p.sum(0)


def log_probs(model, share: np.ndarray, table: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Conditional log-probability of each token given its window; ``table``: the class of each id."""
    out = np.empty(len(ids))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rows, own = embed_rows(ids), table[ids]
    for a in range(0, len(ids), STEP):
        b = min(len(ids), a + STEP)
        _, p, total = _forward(model, _context(model, rows, row, a, b)[0])
        out[a:b] = np.log(p[own[a:b], np.arange(b - a)] / total)
    return out + share[ids]


def train_step(model, memory, rows, own, row, a: int, b: int, rate: float) -> None:
    """A step of AdaGrad on the mean loss of the classes at positions [a, b)."""
    ctx, seen, parts, lo, hi = _context(model, rows, row, a, b)
    hid, g, total = _forward(model, ctx)
    g /= total
    g[own[a:b], np.arange(b - a)] -= 1
    g /= b - a
    back = (model["out"].T @ g) * (1 - hid * hid)
    grad = {"out": g @ hid.T, "out_bias": g.sum(1), "hidden": ctx @ back.T, "hidden_bias": back.sum(1), "side": np.zeros(SHAPES["side"], np.float32)}
    back = (model["hidden"] @ back) * seen
    each = np.zeros((WIDTH, hi - lo), np.float32)
    for j, part in enumerate(parts):
        if part:
            here, there, ok, near = part
            grad["side"][j] = (back[:, here] * near).sum(1)
            each[:, there] += model["side"][j][:, None] * back[:, here] * ok
    order = np.argsort(rows[lo:hi], kind="stable")  # a radix sort
    used = rows[lo:hi][order]
    head = np.flatnonzero(np.concatenate(([True], used[1:] != used[:-1])))
    g, used = np.add.reduceat(each.T[order], head, axis=0), used[head]
    m = memory["embed"][used] + g * g
    memory["embed"][used] = m
    model["embed"][used] -= rate * g / np.sqrt(m)
    for k, g in grad.items():
        memory[k] += g * g
        model[k] -= rate * g / np.sqrt(memory[k])


def learn(model, memory, table: np.ndarray, column: pa.Array, rate: float = 0.1) -> int:
    """Go over all positions of a slice of texts once; the number of tokens."""
    ids, first = tokens(column)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    rows, own = embed_rows(ids), table[ids]
    for a in range(0, len(ids), STEP):
        train_step(model, memory, rows, own, row, a, min(len(ids), a + STEP), rate)
    return len(ids)


def fresh(seed: int = 3):
    return start(seed), {k: np.full(s, 1e-7, np.float32) for k, s in SHAPES.items()}


def _train_map(held):
    """Models of groups of rows; ``held.value`` starts with the class of each id."""

    def run(batches):
        table = held.value[0]
        group, model, memory, count = None, None, None, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([pack(model)], pa.binary())], ["tokens", "model"])
        for batch in batches:
            key, text = batch.column("group").to_numpy(), batch.column("text")
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if key[i] != group:
                    if count:
                        yield done()
                    group, count = key[i], 0
                    model, memory = fresh()
                for a, b in _vec.slices(text[i:j], SLICE):
                    count += learn(model, memory, table, text[i:j][a:b])
        if count:
            yield done()

    return run


def _mean_map(batches):
    total, weight = None, 0
    for batch in batches:
        for n, raw in zip(batch.column("tokens").to_pylist(), batch.column("model")):
            x = np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64) * n
            total, weight = x if total is None else total + x, weight + n
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["tokens", "model"])


def train(spark: SparkSession, docs: DataFrame, held, group_rows: int = 8192) -> bytes:
    """Parameters after one pass over all positions; those of the start if there are no tokens."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, docs.count() // group_rows)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("group"))
    ordered = keyed.repartitionById(min(parts, groups), "group").sortWithinPartitions("group", "doc_id", "hash").select("group", "text")
    mean = ordered.mapInArrow(_train_map(held), "tokens long, model binary")
    while groups > 1:  # no task averages more than some FAN models, however many groups there are
        groups = -(-groups // FAN)
        mean = mean.repartition(groups).mapInArrow(_mean_map, "tokens long, model binary")
    got = mean.collect()
    return bytes(got[0][1]) if got else pack(start())


COUNTED = "part int, words binary, counts binary, company binary"
#: Ranges of ids that are merged apart; distinct words that a task holds before it passes them on; steps of a document's vector.
PARTS, HELD, STEPS = 32, 1 << 20, 31


#: The signs that the bits of a number stand for.
_SIGNS = ((np.arange(1 << SKETCH)[:, None] >> np.arange(SKETCH) & 1) * 2 - 1).astype(np.int8)


def company(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token its document as SKETCH small whole numbers: sums of random signs of its words, at unit length."""
    sign = _SIGNS[(_vec.mix(ids.astype(np.uint64) + np.uint64(0xC0FFEE)) & np.uint64((1 << SKETCH) - 1)).astype(np.intp)]
    some = np.flatnonzero(np.diff(first))
    total = np.zeros((len(first) - 1, SKETCH), np.int32)
    if len(some):
        total[some] = np.add.reduceat(sign, first[some], axis=0, dtype=np.int32)
    size = np.sqrt((total.astype(float) ** 2).sum(1))
    vector = np.round(STEPS * total / np.maximum(size, 1)[:, None]).astype(np.int32)
    return np.repeat(vector, np.diff(first), axis=0)


def _grouped(ids: np.ndarray, n: np.ndarray, sums: np.ndarray):
    """(distinct ids in order, their numbers, their sums)."""
    order = np.argsort(ids, kind="stable")
    own = ids[order]
    at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return own[at], np.add.reduceat(n[order], at), np.add.reduceat(sums[order], at, axis=0)


def _count_map(batches):
    """The distinct words of a task with their numbers and the sums of their documents' vectors, packed by ranges of the id."""

    def packed(held):
        ids, n, sums = _grouped(*(np.concatenate(c) for c in zip(*held)))
        cut = np.searchsorted(ids, np.arange(PARTS + 1) * (WORDS // PARTS))
        rows = [(k, ids[a:b].astype(np.int32).tobytes(), n[a:b].tobytes(), sums[a:b].astype(np.int32).tobytes()) for k, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "words", "counts", "company"])

    held, size, tokens_held = [], 0, 0
    for batch in batches:
        for a, b in _vec.slices(batch.column("text"), SLICE):
            ids, first = tokens(batch.column("text")[a:b])
            if not len(ids):
                continue
            held.append(_grouped(ids, np.ones(len(ids), np.int64), company(ids, first)))
            size, tokens_held = size + len(held[-1][0]), tokens_held + len(ids)
            if size > HELD:
                held = [_grouped(*(np.concatenate(c) for c in zip(*held)))]
                size = len(held[0][0])
                if size > HELD // 2 or tokens_held > 1 << 25:  # sums fit 32 bits
                    yield packed(held)
                    held, size, tokens_held = [], 0, 0
    if held:
        yield packed(held)


def _merge_map(batches):
    """The same for whole ranges of ids, each word once."""
    found: dict[int, list] = {}
    for batch in batches:
        for k, *raw in zip(batch.column("part").to_pylist(), *(batch.column(c) for c in ("words", "counts", "company"))):
            ids, n, sums = (np.frombuffer(r.as_buffer(), t) for r, t in zip(raw, (np.int32, np.int64, np.int32)))
            now = (ids.astype(np.int64), n, sums.reshape(-1, SKETCH).astype(np.int64))
            found[k] = _grouped(*(np.concatenate(c) for c in zip(found[k], now))) if k in found else now
    for k, (ids, n, sums) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids.astype(np.int32), n, sums.astype(np.int64)))], ["part", "words", "counts", "company"])


def _moments_map(batches):
    """Number, sum and squares of the words' mean vectors in each range, weighted by their numbers."""
    for batch in batches:
        for k, counts, sums in zip(batch.column("part").to_pylist(), batch.column("counts"), batch.column("company")):
            n = np.frombuffer(counts.as_buffer(), np.int64)
            x = np.frombuffer(sums.as_buffer(), np.int64).reshape(-1, SKETCH) / n[:, None]
            total = np.concatenate(([n.sum()], (n[:, None] * x).sum(0), ((n[:, None] * x).T @ x).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])


def _class_map(axes: np.ndarray, middle: np.ndarray):
    """The class of each word: a bit for each axis, by the side of the middle on which its mean vector lies."""

    def run(batches):
        for batch in batches:
            for k, words, counts, sums in zip(batch.column("part").to_pylist(), *(batch.column(c) for c in ("words", "counts", "company"))):
                n = np.frombuffer(counts.as_buffer(), np.int64)
                x = np.frombuffer(sums.as_buffer(), np.int64).reshape(-1, SKETCH) / n[:, None]
                own = ((x @ axes.T > middle) << np.arange(AXES)).sum(1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([words.as_buffer().to_pybytes()], pa.binary()), pa.array([counts.as_buffer().to_pybytes()], pa.binary()), pa.array([own.tobytes()], pa.binary())], ["part", "words", "counts", "company"])

    return run


def vocabulary(spark: SparkSession, docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(class of each id, log of its share of its class's tokens) over the whole corpus: 5 bytes an id, whatever the corpus.

    All sums are of whole numbers, and ranges of ids are worked out in order, so that classes don't depend on how the table
    is split."""
    scratch = Scratch(spark, "masked")
    counted = scratch.cut(docs.select("text").mapInArrow(_count_map, COUNTED).repartition(PARTS, "part").mapInArrow(_merge_map, COUNTED))
    table, share = np.zeros(WORDS, np.uint8), np.full(WORDS, -30.0, np.float32)
    total = sum((np.frombuffer(r.total) for r in sorted(counted.mapInArrow(_moments_map, "part int, total binary").collect())), np.zeros(1 + SKETCH + SKETCH**2))
    if total[0]:
        mean, square = total[1 : 1 + SKETCH] / total[0], total[1 + SKETCH :].reshape(SKETCH, SKETCH) / total[0]
        axes = np.linalg.eigh(np.round(square - np.outer(mean, mean), 9))[1][:, ::-1][:, :AXES].T
        axes = axes * np.sign(axes[np.arange(AXES), np.abs(axes).argmax(1)])[:, None]
        of = np.zeros(CLASSES)
        found = counted.mapInArrow(_class_map(axes, axes @ mean), COUNTED).collect()  # 13 bytes a word, of WORDS at most
        for r in found:
            ids, n, own = np.frombuffer(r.words, np.int32), np.frombuffer(r.counts, np.int64), np.frombuffer(r.company, np.uint8)
            table[ids], share[ids] = own, np.log(n)
            of += np.bincount(own, n, minlength=CLASSES)
        for r in found:
            ids = np.frombuffer(r.words, np.int32)
            share[ids] -= np.log(of[table[ids]]).astype(np.float32)
    scratch.free(counted)
    return table, share


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, score, mean, n_tokens): score sums the conditional log-probabilities of a whole text, mean is that by token, which
    compares texts of unlike lengths.

    Null, empty and wordless texts have 0 tokens, score 0 and a null mean. A text of one token is predicted from an
    empty context. Repeated rows count and are scored each, with equal scores; rows with a null id take part like others;
    other columns play no part, whatever their names; an empty table gives no rows."""
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    words = spark.sparkContext.broadcast(vocabulary(spark, docs))  # 80 MB
    network = spark.sparkContext.broadcast(train(spark, docs, words))

    def run(batches):
        table, share = words.value
        model = unpack(network.value)
        for batch in batches:
            for a, b in _vec.slices(batch.column("text"), SLICE):
                ids, first = tokens(batch.column("text")[a:b])
                total = np.concatenate(([0.0], np.cumsum(log_probs(model, share, table, ids, first))))
                n = np.diff(first)
                lp = total[first[1:]] - total[first[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(lp), pa.array(lp / np.maximum(n, 1), mask=n == 0), pa.array(n.astype(np.int64))], ["doc_id", "score", "mean", "n_tokens"])

    return docs.mapInArrow(run, "doc_id long, score double, mean double, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
