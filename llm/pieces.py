"""SentencePiece encoding and decoding with Gumbel top-k sampling.

Text becomes the model's symbols (a mark for each space, one in front) and a lattice: an edge for each vocabulary piece,
and one of byte pieces for a character that has none. Where two neighbouring characters stand together in no piece, no
edge spans their border, so the lattice is a chain of small ones cut at all such places (starts of words are some; text
without spaces has others), one for each distinct stretch of a slice of rows; a slice is worked on as flat arrays, all
rows at once. Edges weigh ``-temperature * log(rank + 2)`` by merge rank.

Sampling is an A* search over perturbed log-masses: the root's value is Gumbel noise around the lattice's mass, each
node passes its value on to its best child, which has its share of the mass as probability, and truncated Gumbel values to the others, and the largest open value is
expanded next. Complete paths come out in falling order of value: a sample without replacement, in which the k-th
lower bound gives each path's inclusion score 1 - exp(-exp(log p - kappa)). All noise is a hash of the row key.
"""

from __future__ import annotations

from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec
from ._scratch import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"


#: Kinds of pieces in a model file.
UNKNOWN, CONTROL, UNUSED, BYTE = 2, 3, 5, 6
#: What the unknown piece decodes to.
UNKNOWN_TEXT = " \u2047 "


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while True:
        x = raw[at]
        value, shift, at = value | (x & 127) << shift, shift + 7, at + 1
        if x < 128:
            return value, at


def _fields(raw: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        if tag & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def read_model(path: str) -> list[tuple[str, int]]:
    """(piece, kind) in the order of ids. The file is read directly: a loaded processor takes tens of MB a worker."""
    with open(path, "rb") as f:
        raw = f.read()
    parts = (dict(_fields(value)) for number, value in _fields(raw) if number == 1)
    return [(part.get(1, b"").decode(), part.get(3, 1)) for part in parts]


class Vocabulary:
    """The model's pieces as a trie in a hash table: (state, character) to state, looked up for many places at once."""

    def __init__(self, path: str, temperature: float):
        model = read_model(path)
        n = len(model)
        kind = np.array([k for _, k in model])
        is_byte = kind == BYTE
        self.byte = np.zeros(256, np.int32)
        for i in np.flatnonzero(is_byte).tolist():
            self.byte[int(model[i][0][3:5], 16)] = i
        usable = {p: i for i, (p, k) in enumerate(model) if k not in (UNKNOWN, CONTROL, UNUSED, BYTE)}
        self.weight = -temperature * np.log(np.arange(n) + 2.0)
        self.fallback = -temperature * log(n + 2)
        self.char = np.zeros(0x110000, np.int32)
        letters = sorted({c for p in usable for c in p})
        self.char[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        number = dict(zip(letters, range(1, self.width)))
        pairs = np.zeros(self.width**2, bool)  # neighbours inside a piece
        child, ends = {}, [-1]
        for p, i in usable.items():
            state, last = 0, 0
            for c in map(number.__getitem__, p):
                if last:
                    pairs[last * self.width + c] = True
                key = state * self.width + c
                if key not in child:
                    child[key] = len(ends)
                    ends.append(-1)
                state, last = child[key], c
            ends[state] = i
        self.pairs = np.packbits(pairs, bitorder="little")
        self.ends = np.array(ends, np.int32)
        self.raw = pa.array([bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else UNKNOWN_TEXT.encode() if k == UNKNOWN else p.encode() for p, k in model], pa.large_binary())
        self.start = np.zeros(self.width, np.int32)
        self.start[1:] = [child.get(c, 0) for c in range(1, self.width)]
        bits = (4 * len(child)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.next = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        keys, to = np.array(list(child), np.int64), np.array(list(child.values()), np.int32)
        for key, value, slot in zip(keys.tolist(), to.tolist(), self._slot(keys).tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.next[slot] = key, value

    def apart(self, cls: np.ndarray) -> np.ndarray:
        """Whether no piece holds each character together with the one before it (the first: always)."""
        out = np.ones(len(cls), bool)
        key = cls[:-1].astype(np.int64) * self.width + cls[1:]
        out[1:] = (self.pairs[key >> 3] >> (key & 7).astype(np.uint8)) & 1 == 0
        return out

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next state of each place, or 0."""
        key = state.astype(np.int64) * self.width + char
        slot = self._slot(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.next[slot], 0)
        todo = np.flatnonzero((seen != key) & (seen >= 0))
        while len(todo):
            slot[todo] = at = (slot[todo] + 1) & self.mask
            seen = self.keys[at]
            hit = seen == key[todo]
            out[todo[hit]] = self.next[at[hit]]
            todo = todo[~hit & (seen >= 0)]
        return out


@lru_cache(2)
def vocabulary(path: str, temperature: float) -> Vocabulary:
    return Vocabulary(path, temperature)


def decode(voc: Vocabulary, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
    """The texts of segmentations that lie one after the other, ``sizes`` pieces each: pieces and bytes put together (bytes
    that are no UTF-8 become U+FFFD), marks to spaces, the space in front dropped."""
    if not len(ids):
        return [""] * len(sizes)
    taken = voc.raw.take(pa.array(ids, pa.int32()))
    at = np.frombuffer(taken.buffers()[1], np.int64)[np.concatenate(([0], np.cumsum(sizes)))].tolist()
    data = taken.buffers()[2].to_pybytes()
    return [data[a:b].decode(errors="replace").replace(MARK, " ").removeprefix(" ") for a, b in zip(at, at[1:])]


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for count[i] places, one after the other."""
    at = np.cumsum(count) - count
    return np.repeat(start - at, count) + np.arange(int(count.sum()))


class Lattice:
    """The lattices of the distinct words of some texts. Nodes are places in the distinct words' characters and
    their ends, numbered by the characters that are left: the ends of the ``words`` words come first, ``root`` is each word's start; ``first`` edge of each node, and of each edge ``src``, ``to``, piece ``ids`` (-1: bytes), ``logp``, ``prob``."""

    def __init__(self, voc: Vocabulary, texts: list[str]):
        self.voc = voc
        raw = [(MARK + t.replace(" ", MARK)).encode("utf-32-le", "surrogatepass") if t else b"" for t in texts]
        text = np.frombuffer(b"".join(raw), np.int32)
        if not len(text):
            self.doc_word = np.zeros(len(texts) + 1, np.int64)
            return
        starts = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw])))
        del raw
        cls = voc.char[text]
        cut = voc.apart(cls)
        cut[starts[starts < len(text)]] = True
        begin = np.flatnonzero(cut)
        length = np.diff(np.append(begin, len(text)))
        self.doc_word = np.searchsorted(begin, starts)  # first word of each text, and the total
        # distinct words by hash, held against the characters themselves
        power = _vec._powers(int(length.max()))[_ragged(np.zeros(len(begin), np.int64), length)]
        value = _vec.mix(np.add.reduceat(_vec.mix(text.astype(np.uint64) + np.uint64(1)) * power, begin) + length.astype(np.uint64))
        _, lead, self.word = np.unique(value, return_index=True, return_inverse=True)
        same = (length == length[lead][self.word]).all() and (text == text[_ragged(begin[lead][self.word], length)]).all()
        if not same:
            distinct: dict[bytes, int] = {}
            self.word = np.array([distinct.setdefault(text[a : a + k].tobytes(), len(distinct)) for a, k in zip(begin.tolist(), length.tolist())], np.int64)
            lead = np.unique(self.word, return_index=True)[1]
        size = length[lead]
        code = text[_ragged(begin[lead], size)]
        level = np.cumsum(np.bincount(size, minlength=int(size.max()) + 1)[::-1])[::-1]  # words with as many characters or more
        start = np.concatenate(([0], np.cumsum(level)))
        rank = np.empty(len(size), np.int64)
        rank[np.argsort(-size, kind="stable")] = np.arange(len(size))
        self.words, total = len(size), int(start[-1])
        self.root = start[size] + rank
        # edges are found by places in the words' own order of characters, taken in the order of their nodes
        left = np.repeat(size, size + 1) - _ragged(np.zeros(len(size), np.int64), size + 1)
        node = (start[left] + np.repeat(rank, size + 1)).astype(np.int32)
        place = np.empty(total, np.int32)
        place[node] = np.arange(total, dtype=np.int32)
        inner = np.flatnonzero(left)
        chars, cls = np.zeros(total, np.int32), np.zeros(total, np.int32)
        chars[inner] = code
        cls[inner] = voc.char[code]
        self.chars, self.place = chars, place
        # edges, depth by depth: only places whose prefix is still in the trie go on
        src, dst, piece = [], [], []
        where, state, depth = place[self.words :], None, 0
        while len(where):
            c = cls[where + depth]
            ok = np.flatnonzero(c)
            where, state = where[ok], voc.step(state[ok], c[ok]) if depth else voc.start[c[ok]]
            ok = np.flatnonzero(state)
            where, state, depth = where[ok], state[ok], depth + 1
            found = voc.ends[state]
            ok = np.flatnonzero(found >= 0)
            piece.append(found[ok])
            src.append(node[where[ok]])
            dst.append(node[where[ok] + depth])
        single = np.zeros(total, bool)
        single[src[0]] = single[: self.words] = True
        bare = np.flatnonzero(~single).astype(np.int32)
        src, dst, piece = np.concatenate([bare, *src]), np.concatenate([node[place[bare] + 1], *dst]), np.concatenate([np.full(len(bare), -1, np.int32), *piece])
        order = np.argsort(src, kind="stable")
        self.src, self.to, self.ids = src[order], dst[order], piece[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(src, minlength=total))))
        weight = voc.weight[self.ids]
        bare = np.flatnonzero(self.ids < 0)
        cp = chars[place[self.src[bare]]]
        weight[bare] = voc.fallback * (1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))
        # log-mass from each node to its word's end, level by level
        beta = np.zeros(total)
        self.logp = np.empty(len(weight))
        for low, high in zip(start[1:-1].tolist(), start[2:].tolist()):
            cut = self.first[low : high + 1]
            edges = slice(cut[0], cut[-1])
            n = np.diff(cut)
            x = weight[edges] + beta[self.to[edges]]
            top = np.maximum.reduceat(x, cut[:-1] - cut[0])
            b = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, n)), cut[:-1] - cut[0]))
            beta[low:high] = b
            self.logp[edges] = x - np.repeat(b, n)
        self.prob = np.exp(self.logp)


def _uniform(seed: np.ndarray, a, b, trial: int) -> np.ndarray:
    """Numbers between 0 and 1 by hash of the row's seed, the trial and two counters."""
    a, b = (np.atleast_1d(x).astype(np.uint64) for x in (a, b))
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x = _vec.mix(x + seed + np.uint64(trial * 0x165667B19E3779F9 & (1 << 64) - 1))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _walk(lat: Lattice, seed, node, word, count, trial):
    """From open nodes to the ends of their words, all at once: (word, step, edge).

    The best child of a node is each child by its share of the mass, whatever the node's value; long pieces, which are
    the likeliest, are tried first. ``count`` is a word's number within its text, on which the choice depends."""
    got, step = [], 0
    key = _vec.mix(seed + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    while len(node):
        u = _uniform(key, step, 0, trial)
        first, edge = lat.first[node], lat.first[node + 1] - 1
        u -= lat.prob[edge]
        todo = np.flatnonzero((u >= 0) & (edge > first))
        while len(todo):
            e = edge[todo] - 1
            edge[todo] = e
            left = u[todo] - lat.prob[e]
            u[todo] = left
            todo = todo[(left >= 0) & (e > first[todo])]
        got.append((word, np.full(len(word), step), edge))
        here = lat.to[edge]
        on = np.flatnonzero(here >= lat.words)
        node, word, key, step = here[on], word[on], key[on], step + 1
    return [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0, int)] * 3


#: Siblings behind a log-probability of NEAR are worked out only for texts without enough open values over FLOOR: the
#: noise has 53 bits, so that it is under 38, and a sibling's value never exceeds its log-probability by more.
NEAR, FLOOR = -50.0, -12.0


def sample(voc: Vocabulary, texts: list[str], keys: list[int], k: int):
    """Up to k distinct segmentations of each text: [(text number, rank, ids, log p, inclusion score)].

    Per text in falling order of perturbed value; where a text has no more than k, all are given with score 1."""
    lat = Lattice(voc, texts)
    m = len(texts)
    out = [(i, 1, np.zeros(0, np.int32), 0.0, 1.0) for i in range(m) if not texts[i]]
    live = np.array([i for i in range(m) if texts[i]], np.int64)
    if not len(live):
        return out
    seed = _vec.mix(np.array(keys, np.int64).view(np.uint64))
    count_of = lat.doc_word[1:] - lat.doc_word[:-1]
    doc_of_word = np.repeat(np.arange(m), count_of)
    bound = np.full(m, -np.inf)
    bound[live] = -np.log(-np.log(_uniform(seed[live], 1, 2, 0)))
    word = _ragged(lat.doc_word[live], count_of[live])
    walked = _walk(lat, seed[doc_of_word[word]], lat.root[lat.word[word]], word, word - lat.doc_word[doc_of_word[word]], 1)
    prefix = [np.zeros(0, np.int64)] * 3  # text, word, edge of what stands before the walk, by text
    paths, opened = [], []
    values = [bound.copy()]
    for p in range(k):
        w, s, edge = walked
        # a complete path lies text by text, word by word; a row's place follows from counts, without a sort
        was = np.bincount(prefix[1], minlength=len(doc_of_word))
        sizes = was + np.bincount(w, minlength=len(doc_of_word))
        start = np.concatenate(([0], np.cumsum(sizes)))
        pe, pw = np.zeros(start[-1], np.int64), np.repeat(np.arange(len(doc_of_word)), sizes)
        pe[_ragged(start[:-1], was)] = prefix[2]
        place = start[w] + was[w] + s
        pe[place] = edge
        pl = lat.logp[pe]
        p_first = start[lat.doc_word]
        cum = np.concatenate(([0.0], np.cumsum(pl)))
        d = doc_of_word[w]
        before = cum[place] - cum[p_first[d]]

        def siblings(at):
            """The untaken children at some rows of the walk: values under their parent's, which is the text's bound."""
            node = lat.src[edge[at]]
            n = lat.first[node + 1] - lat.first[node]
            e, at, nth = _ragged(lat.first[node], n), np.repeat(at, n), _ragged(np.zeros(len(n), np.int64), n)
            other = np.flatnonzero(e != edge[at])
            e, at, nth = e[other], at[other], nth[other]
            text, lp = d[at], lat.logp[e]
            row = place[at] - p_first[text]
            free = before[at] + lp - np.log(-np.log(_uniform(seed[text], row, nth + 1, -p - 1)))
            return text, -np.logaddexp(-bound[text], -free), np.full(len(e), p), row, e, lp

        near = before > NEAR
        opened.append(siblings(np.flatnonzero(near)))
        few = np.bincount(opened[-1][0][opened[-1][1] >= FLOOR], minlength=m) <= k
        opened.append(siblings(np.flatnonzero(~near & few[d])))
        paths.append((pw, pe, pl, p_first))
        od, og, op, orow, oe, ol = (np.concatenate(x) for x in zip(*opened))
        bound = np.full(m, -np.inf)
        np.maximum.at(bound, od, og)
        lead = np.flatnonzero((og == bound[od]) & (og > -np.inf))
        lead = lead[np.unique(od[lead], return_index=True)[1]]
        values.append(bound.copy())
        if p == k - 1 or not len(lead):
            break
        # take each text's best open node out and complete it
        gone = np.zeros(len(od), bool)
        gone[lead] = True
        opened = [tuple(x[~gone] for x in (od, og, op, orow, oe, ol))]
        parts, starts = [], []
        for q in range(len(paths)):
            mine = lead[op[lead] == q]
            t, n = od[mine], orow[mine]
            take = _ragged(paths[q][3][t], n)
            parts.append((np.repeat(t, n), paths[q][0][take], paths[q][1][take]))
            at = paths[q][3][t] + n
            starts.append((t, paths[q][0][at], oe[mine]))
        t, w0, e0 = (np.concatenate(x) for x in zip(*starts))
        merged = [np.concatenate(x) for x in zip(*parts, (t, w0, e0))]
        order = np.argsort(merged[0], kind="stable")
        prefix = [x[order] for x in merged]
        # (a stable sort by text keeps the prefix's order, as the new edge comes last)
        here = lat.to[e0]
        inside = here >= lat.words
        n = lat.doc_word[t + 1] - w0 - 1
        rest = _ragged(w0 + 1, n)
        word = np.concatenate((w0[inside], rest))
        walked = _walk(lat, seed[doc_of_word[word]], np.concatenate((here[inside], lat.root[lat.word[rest]])), word, word - lat.doc_word[doc_of_word[word]], p + 2)
    kappa = values[k] if len(values) > k else np.full(m, -np.inf)
    for q, (_, pe, pl, first) in enumerate(paths):
        log_p = np.add.reduceat(np.append(pl, 0.0), np.minimum(first[:-1], len(pl)))
        for i in np.flatnonzero(np.diff(first)).tolist():
            edge = pe[first[i] : first[i + 1]]
            ids = lat.ids[edge]
            if len(bare := np.flatnonzero(ids < 0)):  # characters without a piece: as many byte pieces as UTF-8 bytes
                raw = [voc.byte[list(chr(lat.chars[lat.place[lat.src[e]]]).encode("utf-8", "surrogatepass"))] for e in edge[bare].tolist()]
                cuts = np.concatenate(([0], bare + 1))
                ids = np.concatenate([x for j, r in enumerate(raw) for x in (ids[cuts[j] : bare[j]], r)] + [ids[cuts[-1] :]])
            lp = float(log_p[i])
            score = 1.0 if kappa[i] == -np.inf else float(-np.expm1(-np.exp(min(lp - kappa[i], 700.0))))
            out.append((i, q + 1, ids, lp, score))
    return out


def _encode_map(k: int, path: str, temperature: float, chars: int = 300_000):
    def run(batches):
        voc = vocabulary(path, temperature)
        for batch in batches:
            for a, b in _vec.slices(batch.column("text"), chars):
                keys = batch.column("doc_id")[a:b]
                texts = [t or "" for t in batch.column("text")[a:b].to_pylist()]
                got = sample(voc, texts, [x or 0 for x in keys.to_pylist()], k)
                got.sort(key=lambda r: r[:2])
                who, rank, ids, lp, inc = zip(*got)
                sizes = np.array([len(x) for x in ids])
                flat = np.concatenate(ids).astype(np.int32)
                back = [x == texts[i] for i, x in zip(who, decode(voc, flat, sizes))]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(who)), pa.array(rank, pa.int32()), lists, pa.array(sizes.astype(np.int32)), pa.array(lp), pa.array(inc), pa.array(back)], ["doc_id", "sample", "ids", "n_pieces", "log_prob", "inclusion", "round_trip"])

    return run


def encode(spark: SparkSession, docs: DataFrame, k: int = 2, path: str = MODEL, temperature: float = 0.2) -> DataFrame:
    """(doc_id, sample, ids, n_pieces, log_prob, inclusion, round_trip) for up to ``k`` segmentations of each text.

    The row key is doc_id (0 if null). Null and empty texts have one segmentation without pieces, as decoding gives the
    empty text; round_trip says that decoding the pieces gives the text back (false only where a text itself holds the
    mark U+2581, which decodes to a space). Texts with fewer than k segmentations give all of them. Repeated rows give
    the same samples; an empty table gives no rows; other columns play no part."""
    small_batches(spark)
    schema = "doc_id long, sample int, ids array<int>, n_pieces int, log_prob double, inclusion double, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode_map(k, path, temperature), schema)


def decoded(spark: SparkSession, encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded`` with the text of its column ids (array<int>) as a column text, which replaces one of that name.

    Null ids, and ids that aren't the model's, give a null text; no ids the empty text. Control pieces decode to nothing.
    Rows are decoded each on their own, so repeated rows give the same; an empty table gives no rows."""
    small_batches(spark)

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        voc = vocabulary(path, 0.0)
        out: list[str | None] = [None] * len(column)
        rows = [x.as_py() for x in column]
        able = [i for i, r in enumerate(rows) if r is not None and all(x is not None and 0 <= x < len(voc.raw) for x in r)]
        sizes = np.array([len(rows[i]) for i in able], np.int64)
        flat = np.fromiter((x for i in able for x in rows[i]), np.int32, int(sizes.sum()))
        for i, x in zip(able, decode(voc, flat, sizes)):
            out[i] = x
        return pa.array(out, pa.string())

    return encoded.withColumn("text", text(F.col("ids").cast("array<int>")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
