"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles fall into bands of size; two sets that reach the Jaccard bound lie in the same or in adjoining
bands, and differ in at most k elements. The domain of shingles is cut into k + 1 + spare parts, so such a pair agrees
in spare + 1 parts at least. A set emits one signature for each of its parts that has elements. Where more than spare
parts are empty, which spare makes rare, it also emits subsets of its empty parts (few parts) or each empty part (many):
no pair is lost, whatever parts are empty. Sets so small that k <= 2 have each element as a part, and enumerate what is
left without up to k of them. A pair that shares fewer signatures
than spare + 1, less the parts that may be empty in both, cannot reach the bound; nor can any pair of a set that shares
fewer than that with all others together. Other candidates are then held against the exact bound on the whole sets.
Equal sets are one node from the start.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec
from ._graph import components
from ._scratch import FEW, Scratch, semi

#: Bytes of signatures that a task pairs at once, about, and bytes of them for each shingle of the input.
PACK_BYTES, SHINGLE_BYTES = 8 << 20, 6
#: Groups up to this size give all their pairs at once; larger ones give pairs with their least member first,
#: and the rest only where components stay apart.
SMALL = 4


@lru_cache(None)
def band(size: int, num: int) -> tuple[int, int]:
    """(number, largest size) of the band that holds ``size``; a size's largest partner lies in the next band at most."""
    low, i = 1, 0
    while (high := low * 100 // num) < size:
        low, i = high + 1, i + 1
    return i, high


@lru_cache(None)
def labels(size: int, num: int) -> tuple[tuple[int, int, int, int], ...]:
    """(band, k, parts, spare) under which a set meets its partners; none where only equal sets can reach the bound."""
    i, high = band(size, num)
    low = [1, 1]  # the least size of the band and of the one below
    while low[0] * 100 // num < size:
        low = [low[0] * 100 // num + 1, low[0]]
    out = []
    for j, top, least in ((i, high, low[1]), (i + 1, (high + 1) * 100 // num, low[0])):
        if k := 2 * top * (100 - num) // (100 + num):
            more = 1
            for _ in range(4):  # most sets of the label have no more empty parts than this
                parts = k + 1 + more
                empty = parts * math.exp(-least / parts)
                more = min(math.ceil(empty + 4 * math.sqrt(empty) + 1), max(2, k // 3))
            out.append((j, k, k + 1 + more, more))
    return tuple(out)


def sets_of(column: pa.Array, n: int):
    """The sorted distinct shingle hashes of each text (words: ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased)."""
    for a, b in _vec.slices(column):
        h, first, _, _ = _vec.words(column[a:b])
        sh = _vec.shingles(h, n)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= n:
                yield np.unique(sh[lo : hi - n + 1])
            elif hi > lo:
                yield np.array([_vec.fold(h[lo:hi], n)], dtype=np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(_vec.mix(np.array([s.sum() * _vec._P + np.uint64(len(s))]))[0].view(np.int64))


def signatures(s: np.ndarray, num: int) -> tuple[np.ndarray, int]:
    """The signatures of a set, and how many of them a partner shares at least."""
    out, least = [], 1023
    spread = _vec.mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A))
    with np.errstate(over="ignore"):
        for j, k, parts, more in labels(len(s), num):
            tag = np.uint64(j * 2_000_003 + 17)
            if k <= 2:
                gone = [np.zeros(1, np.uint64), spread]
                if k == 2 and len(s) > 1:
                    x, y = np.triu_indices(len(s), 1)
                    gone.append(spread[x] + spread[y])
                out.append(_vec.mix(spread.sum() - np.concatenate(gone[: k + 1]) + tag))
                least = 1
                continue
            part = (spread >> np.uint64(16)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            part = part[order]
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            total = np.add.reduceat(spread[order], at)
            have = part[at]
            out.append(_vec.mix(total + (have + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + tag))
            empty = parts - len(have)
            least = min(least, max(1, more + 1 - empty))
            if empty > more:
                void = np.setdiff1d(np.arange(parts), have).tolist()
                void = combinations(void, more + 1) if more <= 2 else ((x,) for x in void)
                codes = np.array([hash(x) & (1 << 64) - 1 for x in void], dtype=np.uint64)
                out.append(_vec.mix(codes * np.uint64(0xC2B2AE3D27D4EB4F) + tag))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), least


def keys_map(n: int):
    def run(batches):
        for batch in batches:
            got = [(len(s), set_key(s)) for s in sets_of(batch.column("text"), n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] if g[0] else None for g in got], pa.int64())], ["doc_id", "n_shingles", "node"])

    return run


NAMES = ["a", "b", "votes", "least", "sig", "members", "leasts"]
#: Bytes of a signature within its bucket, and the largest size that is told from larger ones before sets are verified.
SIG_BYTES, SIZE = 5, (1 << 22) - 1
#: Members of a large group that a row holds at most.
MEMBERS = 1 << 18


def packs_map(n: int, num: int, buckets: int, most: int = 400_000):
    """Signatures leave a task as packed arrays for each bucket: seven bytes an entry, and twelve a set, in place of a row each."""

    def packed(nodes, sizes, leasts, sigs, counts):
        sig = np.concatenate(sigs)
        who = np.repeat(np.arange(len(nodes), dtype=np.uint16), counts)
        to = (sig >> np.uint64(33)) % np.uint64(buckets)
        order = np.argsort(to, kind="stable")
        sig, who, to = sig[order], who[order], to[order]
        at = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        end = np.append(at[1:], len(to))
        rows = []
        nodes, sizes = np.array(nodes, np.int64), (np.minimum(sizes, SIZE) * 1024 + np.array(leasts, np.int64)).astype(np.uint32)
        sig = sig.view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES]
        for a, b in zip(at, end):
            used, local = np.unique(who[a:b], return_inverse=True)
            rows.append((int(to[a]), sig[a:b].tobytes(), local.astype(np.uint16).tobytes(), nodes[used].tobytes(), sizes[used].tobytes()))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], ["bucket", "sig", "who", "nodes", "sizes"])

    def run(batches):
        nodes, sizes, leasts, sigs, counts, total, seen = [], [], [], [], [], 0, set()
        for batch in batches:
            for s in sets_of(batch.column("text"), n):
                if not len(s) or (key := set_key(s)) in seen:  # copies within a task go once
                    continue
                seen.add(key)
                g, least = signatures(s, num)
                if len(g):
                    for x, y in ((nodes, key), (sizes, len(s)), (leasts, least), (sigs, g), (counts, len(g))):
                        x.append(y)
                    total += len(g)
                if total > most or len(nodes) > 60_000:
                    yield packed(nodes, sizes, leasts, sigs, counts)
                    nodes, sizes, leasts, sigs, counts, total = [], [], [], [], [], 0
        if total:
            yield packed(nodes, sizes, leasts, sigs, counts)

    return run


def bucket_map(num: int):
    """Within whole buckets: groups of nodes that share a signature. A row is a pair, or a larger group's members and how
    many signatures (``votes``) have just these."""

    def emit(pairs, runs):
        a, b, least = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        if len(a):
            order = np.lexsort((b, a))
            a, b, least = a[order], b[order], least[order]
            at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            votes = np.diff(np.append(at, len(a)))
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(votes.astype(np.int64)), pa.array(least[at].astype(np.int32)), none, pa.nulls(len(at), pa.list_(pa.int64())), pa.nulls(len(at), pa.list_(pa.int32()))], NAMES)
        rows, total = [], 0
        for sig, votes, members, leasts in runs:  # a group is as many rows as its members need, and a batch holds no more than MEMBERS or so
            for k in range(0, len(members), MEMBERS):
                rows.append((sig, votes, members[k : k + MEMBERS], leasts[k : k + MEMBERS]))
                total += len(rows[-1][2])
                if total >= MEMBERS:
                    yield listed(rows)
                    rows, total = [], 0
        if rows:
            yield listed(rows)

    def listed(rows):
        none = pa.nulls(len(rows), pa.int64())
        at = pa.array(np.concatenate(([0], np.cumsum([len(r[2]) for r in rows]))), pa.int32())
        members, leasts = (pa.ListArray.from_arrays(at, pa.array(np.concatenate([r[i] for r in rows]), kind)) for i, kind in ((2, pa.int64()), (3, pa.int32())))
        return pa.RecordBatch.from_arrays([none, none, pa.array([r[1] for r in rows], pa.int64()), pa.nulls(len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), members, leasts], NAMES)

    def run(batches):
        sig, node, size = [], [], []
        for batch in batches:
            for bucket, s, w, d, z in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sig", "who", "nodes", "sizes"))):
                w = np.frombuffer(w, np.uint16)
                whole = np.zeros((len(w), 8), np.uint8)
                whole[:, :SIG_BYTES] = np.frombuffer(s, np.uint8).reshape(-1, SIG_BYTES)
                sig.append(whole.view(np.uint64).ravel() | np.uint64(bucket << 8 * SIG_BYTES))
                node.append(np.frombuffer(d, np.int64)[w])
                size.append(np.frombuffer(z, np.uint32)[w])
        if not sig:
            return
        sig, node, size = np.concatenate(sig), np.concatenate(node), np.concatenate(size)
        order = np.argsort(sig, kind="stable")
        same = sig[order][1:] == sig[order][:-1]
        keep = np.zeros(len(sig), bool)
        keep[1:] |= same
        keep[:-1] |= same
        order = order[keep]  # what stands alone goes
        order = order[np.lexsort((node[order], sig[order]))]
        sig, node, size = sig[order], node[order], size[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, size = sig[fresh], node[fresh], size[fresh]
        size, least = (x.astype(np.int64) for x in np.divmod(size, 1024))
        if not len(sig):
            return
        at = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        count = np.diff(np.append(at, len(sig)))
        pairs, runs = [], {}
        fits = lambda x, y: 100 * np.minimum(x, y).astype(np.int64) >= num * np.maximum(x, y).astype(np.int64)
        for m in range(2, SMALL + 1):
            base = at[count == m]
            for i, j in combinations(range(m), 2):
                ok = fits(size[base + i], size[base + j])
                pairs.append((node[base + i][ok], node[base + j][ok], np.maximum(least[base + i], least[base + j])[ok]))
        big = count > SMALL
        if big.any():
            lead = np.repeat(at[big], count[big])
            inside = np.repeat(at[big] - np.concatenate(([0], np.cumsum(count[big])[:-1])), count[big]) + np.arange(count[big].sum())
            ok = (lead != inside) & fits(size[lead], size[inside])
            pairs.append((node[lead][ok], node[inside][ok], np.maximum(least[lead], least[inside])[ok]))
            for a, c in zip(at[big], count[big]):
                members = node[a : a + c]
                key = (int(members[0]), int(c), hash(members.tobytes()))
                run = runs.setdefault(key, [int(sig[a].view(np.int64)), 0, members, least[a : a + c]])
                run[1] += 1  # the same members under another signature are another vote and no other group
        yield from emit(pairs, runs.values())

    return run


def blob_map(n: int):
    """Whole sets as packed 48-bit hashes, each set of a task once."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            got = {}
            for s in sets_of(batch.column("text"), n):
                if len(s) and (key := set_key(s)) not in seen:
                    got[key] = np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()
                    seen.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.binary())], ["node", "blob"])

    return run


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def verify_map(num: int):
    def run(batches):
        last, left = None, None
        for batch in batches:
            a, b, ok = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for x, s, t in zip(a, batch.column("blob_a"), batch.column("blob_b")):
                if x != last:
                    last, left = x, _unpack(s.as_py())
                right = _unpack(t.as_py())
                small, large = (left, right) if len(left) <= len(right) else (right, left)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                ok.append(100 * both >= num * (len(left) + len(right) - both))
            keep = [i for i, k in enumerate(ok) if k]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    return run


#: Bits of a set's profile, and members of a block of a large group.
PROFILE, BLOCK = 4096, 2000


def profile_map(batches):
    """The parity of the number of each set's elements in PROFILE bins, a bit each: two profiles differ in no more bits
    than the sets in elements."""
    for batch in batches:
        out = []
        for x in batch.column("blob"):
            count = np.bincount(((_unpack(x.as_py()) >> np.uint64(20)) % np.uint64(PROFILE)).astype(np.int64), minlength=PROFILE)
            out.append(np.packbits((count & 1).astype(np.uint8)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], ["node", "profile"])


def _rest_pairs(num: int, nearest: bool):
    """Of the members of a group (or of two blocks of it) the pairs in unlike components whose sizes and profiles allow
    the bound; or only each member's nearest such partner. What is looked at stays in the task; few pairs leave it."""

    def run(frames):
        for f in frames:
            left, right = [], []
            for ids, comps, sizes, profiles, sides in zip(f["node"], f["comp"], f["size"], f["profile"], f["side"]):
                ids, comps, sizes, sides = np.asarray(ids), np.asarray(comps), np.asarray(sizes, np.int64), np.asarray(sides)
                prof = np.frombuffer(b"".join(profiles), np.uint64).reshape(-1, PROFILE // 64)
                halves = len(np.unique(sides)) > 1  # two blocks: only pairs across
                for i in range(len(ids)):
                    first = 0 if nearest else i + 1
                    rest = slice(first, None)
                    ok = (comps[rest] != comps[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= num * np.maximum(sizes[rest], sizes[i]))
                    if halves:
                        ok &= sides[rest] != sides[i]
                    at = np.flatnonzero(ok) + first
                    if not len(at):
                        continue
                    apart = np.bitwise_count(prof[at] ^ prof[i]).sum(1, dtype=np.int64)
                    near = apart * (100 + num) <= (sizes[at] + sizes[i]) * (100 - num)
                    if nearest and near.any():
                        near &= np.arange(len(at)) == int(np.where(near, apart, np.iinfo(np.int64).max).argmin())
                    other = ids[at[near]]
                    if len(other):
                        left.append(np.minimum(other, ids[i]))
                        right.append(np.maximum(other, ids[i]))
            if left:
                yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)}).drop_duplicates()

    return run


def grouped(met: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, node), written: the members of large groups that may have a partner in them.

    A node shares with a partner no more signatures than all its large groups have and those that one pair has votes for.
    Where that is less than a partner must share, as where a common passage alone makes the group, the node leaves them."""
    members = found.where("sig is not null").select("sig", "votes", F.explode(F.arrays_zip("members", "leasts")).alias("m"))
    members = scratch.cut(members.select("sig", "votes", F.col("m.members").alias("node"), F.col("m.leasts").alias("least")))
    pair = met.select(F.col("a").alias("node"), "votes").union(met.select(F.col("b").alias("node"), "votes")).groupBy("node").agg(F.max("votes").alias("pair"))
    total = members.groupBy("node").agg(F.sum("votes").alias("votes"), F.max("least").alias("least")).join(pair, "node", "left")
    able = scratch.cut(total.where(F.col("votes") + F.coalesce("pair", F.lit(0)) >= F.col("least")).select("node"))
    out = scratch.cut(semi(members.select("sig", "node"), able, "node"))
    scratch.free(members, able)
    return out


def similarity_join(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80, count_links: bool = False) -> DataFrame:
    """Groups of documents whose shingle sets reach a Jaccard similarity of ``percent`` / 100.

    ``docs`` needs doc_id and text; other columns are left out. Returns doc_id, n_shingles, component_id, and
    with ``count_links`` n_links: all links of the document's set to unlike sets (copies are not expanded), for which every
    candidate pair is verified, in dense groups as many as there are links. Null and empty texts, and
    texts without words, have 0 shingles and are their own component; a text of fewer than n words is one shingle.
    Rows that repeat an id give a row each; a null id gives a null component unless its set has other documents.
    An empty table gives an empty result."""
    scratch = Scratch(spark, "ngram")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keys = scratch.cut(docs.mapInArrow(keys_map(n), "doc_id long, n_shingles long, node long"))
    nodes = scratch.cut(keys.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").cast("int").alias("size")))
    shingles_ = keys.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shingles_ * SHINGLE_BYTES // PACK_BYTES + 1)
    packs = docs.mapInArrow(packs_map(n, percent, buckets), "bucket int, sig binary, who binary, nodes binary, sizes binary")
    found = scratch.cut(packs.repartitionById(buckets, "bucket").mapInArrow(bucket_map(percent), "a long, b long, votes long, least int, sig long, members array<long>, leasts array<int>"))
    del packs
    scratch.sweep()
    met = scratch.cut(found.where("a is not null").groupBy("a", "b").agg(F.sum("votes").alias("votes"), F.max("least").alias("least")))
    pairs = scratch.cut(met.where("votes >= least").select("a", "b", "votes"))
    runs = grouped(met, found, scratch)
    scratch.sweep(met, found)
    in_pairs = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(runs.select("node")).distinct()
    wanted = scratch.cut(nodes.join(in_pairs, "node", "left_semi").select("node", "rep"))
    # a node's text is that of its least doc_id, or of a row without an id if it has no other
    ids = scratch.cut(wanted.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct())
    texts = semi(docs, ids, "doc_id")
    if wanted.where("rep is null").limit(1).count():
        texts = texts.union(docs.where("doc_id is null"))
    blobs = scratch.cut(texts.mapInArrow(blob_map(n), "node long, blob binary"))
    if blobs.count() != blobs.select("node").distinct().count():  # rows that repeat an id, or have none
        again, blobs = blobs, scratch.cut(blobs.dropDuplicates(["node"]))
        scratch.free(again)
    del texts
    scratch.sweep(wanted, ids)

    def verified(these: DataFrame) -> DataFrame:
        """The pairs of the written table ``these`` that reach the bound; only the sets they name are shuffled."""
        sides = []
        for x in "ab":
            own = scratch.cut(these.select(F.col(x).alias("node")).distinct())
            sides.append((own, semi(blobs, own, "node").select(F.col("node").alias(x), F.col("blob").alias(f"blob_{x}"))))
        (own_a, blob_a), (own_b, blob_b) = sides
        both = these.select("a", "b").join(blob_b, "b").join(blob_a, "a")
        out = scratch.cut(both.select("a", "b", "blob_a", "blob_b").mapInArrow(verify_map(percent), "a long, b long"))
        del sides, blob_a, blob_b, both
        scratch.sweep(own_a, own_b)
        return out

    def apart(these: DataFrame, comp: DataFrame) -> DataFrame:
        """Pairs whose components differ."""
        ca, cb = (comp.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
        out = these.join(ca, "a", "left").join(cb, "b", "left")
        return out.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")

    # 1. each node with the least-numbered partner that shares most signatures; most groups close here
    best = scratch.cut(pairs.groupBy("b").agg(F.max(F.struct("votes", "a")).alias("x")).select(F.col("x.a").alias("a"), "b"))
    links = verified(best)
    comp = components(links, scratch)
    scratch.free(links)
    # 2. what is still apart
    rest = scratch.cut(apart(pairs, comp).join(best, ["a", "b"], "left_anti"))
    comp = _grown(comp, verified(rest), scratch)
    scratch.sweep(best, rest)
    # 3. large groups that still span components: rounds in which each member meets its nearest partner beyond its own
    # component, which join most of what belongs together; then all pairs across components, whatever is left
    tried = [pairs.select("a", "b")]

    def across_of(comp: DataFrame | None, nearest: bool) -> DataFrame | None:
        """Pairs of members of large groups that profiles allow; ``comp`` None: whatever is joined already. None where no
        group spans components."""
        member = runs.join(comp, "node", "left").select("sig", "node", F.coalesce("comp", "node").alias("comp")) if comp is not None else runs.select("sig", "node", F.col("node").alias("comp"))
        open_ = scratch.cut(member.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("x <> y").select("sig", "blocks"))
        if comp is not None and not open_.limit(1).count():
            scratch.free(open_)
            return None
        member = scratch.cut(member.join(open_, "sig"))
        who = scratch.cut(member.select("node").distinct())
        profiles = scratch.cut(semi(blobs, who, "node").mapInArrow(profile_map, "node long, profile binary"))
        wide = member.join(nodes.select("node", "size"), "node").join(profiles, "node")
        mine = F.pmod(F.xxhash64("node"), "blocks").cast("int")
        wide = wide.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        fields = F.struct("node", "comp", "size", "profile", (F.col("mine") <= F.col("other")).alias("side"))
        groups = wide.groupBy("sig", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")).agg(F.collect_list(fields).alias("m"))
        groups = groups.select(*(F.col(f"m.{c}").alias(c) for c in ("node", "comp", "size", "profile", "side")))
        out = groups.mapInPandas(_rest_pairs(percent, nearest), "a long, b long").distinct()
        for t in tried if comp is not None else []:
            out = out.join(t, ["a", "b"], "left_anti")
        out = scratch.cut(out)
        del wide, groups
        scratch.sweep(open_, member, who, profiles)
        return out

    for nearest in (True, True, False):
        across = across_of(comp, nearest)
        if across is None:
            break
        if across.limit(1).count():
            comp = _grown(comp, verified(across), scratch)
        tried.append(across)
    home = nodes.join(comp, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    least = home.groupBy("comp").agg(F.min("rep").alias("component_id"))
    home = home.join(least, "comp").select("node", "component_id")
    out = keys.join(home, "node", "left").select("node", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    if count_links:
        every = verified(scratch.cut(pairs.select("a", "b").union(across_of(None, False)).distinct()))  # no pair is left out as joined already
        degree = every.select(F.col("a").alias("node")).union(every.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
        out = out.join(degree, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    out = scratch.cut(out.drop("node"))
    scratch.sweep(keys, nodes, pairs, runs, blobs, comp, *tried)
    return out


def _grown(comp: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """Components after further links; those found so far stand for the links they were made of."""
    if not more.limit(1).count():
        scratch.free(more)
        return comp
    stars = comp.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    out = components(stars.union(more.select("a", "b")), scratch)
    scratch.sweep(comp, more)
    return out


def keep_one(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with only the least doc_id of each group; documents without words stay. The ids that go are sent to every
    task up to FEW of them, so that texts aren't shuffled; beyond, texts are shuffled once."""
    groups = similarity_join(spark, docs, n, percent)
    gone = Scratch(spark, "copies").cut(groups.groupBy("doc_id").agg(F.bool_or(F.expr("doc_id <=> component_id")).alias("stays")).where("not stays").select("doc_id"))
    gone = F.broadcast(gone) if gone.count() <= FEW else gone
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return similarity_join(spark, docs, n=4, percent=85).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
        ELSE list_distinct(list_transform(range(1, len(t) - 2), lambda i: t[i] || ' ' || t[i+1] || ' ' || t[i+2] || ' ' || t[i+3])) END AS g FROM w),
z AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM e p JOIN e q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 100 * k >= 85 * (za.n + zb.n - k)),
l2 AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS o, doc_id AS v FROM z UNION SELECT r.o, l2.b FROM r JOIN l2 ON l2.a = r.v)
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_shingles, min(r.v) AS component_id FROM z JOIN r ON r.o = z.doc_id GROUP BY z.doc_id, z.n
"""
