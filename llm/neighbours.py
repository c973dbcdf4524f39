"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, kept as flat arrays.

Rows are dealt to shards of about ``shard_rows`` by a hash of the id, so that no shard depends on the data's clusters.
Equal vectors of a shard are one node that carries all its ids. Nodes enter the graph in random order, in batches that
grow with it: a batch searches the graph as it stands, level by level, all its nodes at once; its own nodes are candidates
of each other as well. No distance matrix of a shard is ever made.

Rows of unlike magnitude go to shards of their own, scaled to single precision; where a query is so far out of a shard's
scale that this couldn't tell its rows apart, all of them are measured.

Every query searches every shard. Queries travel in packed blocks behind their shard's graph, and a task reads its graph
once, then block by block. The graph is walked in single precision; what it finds is measured on the original vectors in
double precision, and results merge by that distance and the id, the best ``k`` kept at each step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._scratch import FEW, Scratch

#: Rows of a shard; links of a node (twice as many on the lowest level); nodes kept in sight while building and searching.
SHARD_ROWS, LINKS, BUILD, SEARCH = 1 << 15, 16, 64, 384
#: Nodes opened at a time, and nodes of a batch by the number of nodes there are.
OPEN, MOST = 4, 512
#: Queries of a block; blocks that a task reads behind one copy of a graph; bytes of a piece of a graph.
BLOCK, BLOCKS, PIECE = 1024, 64, 4 << 20
_FAR = np.float32(np.inf)
#: Powers of two of a vector's largest component that share shards; a query's component beyond a shard's, from which all of
#: its rows are measured.
SCALE, BEYOND = 8, 2.0**18


def scale_of(largest: np.ndarray) -> np.ndarray:
    """The class of magnitude of vectors by their largest component; limits lie beside common sizes."""
    return np.floor((np.log2(largest) + 3.3) / SCALE).astype(np.int32)


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to a vector in double precision, whatever the exponents."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = np.sqrt(((x - v) ** 2).sum(1))
    odd = np.flatnonzero(~(d < 1e150) | (d < 1e-140))  # squares may have left the range
    if len(odd):
        away = np.abs(x[odd] / 4 - v / 4)
        most = away.max(1)
        at = most > 0
        with np.errstate(over="ignore"):
            d[odd[at]] = 4 * (most[at] * np.sqrt(((away[at] / most[at, None]) ** 2).sum(1)))
        tiny = odd[~at]
        if len(tiny):  # what a quarter of can't be told from 0
            d[tiny] = np.abs(x[tiny] - v).max(1)
    return d


class Graph:
    """Nodes are numbered as they enter. ``link[l]`` holds the neighbours on level l as a flat table with a row for each node
    of the level (-1: none), ``row[l]`` the row of a node; level 0 has all nodes."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, id_start: np.ndarray, level: np.ndarray, links: int = LINKS):
        self.x, self.ids, self.id_start, self.level, self.links = x, ids, id_start, level, links
        self.power = int(np.frexp(np.abs(x).max())[1]) if x.size else 0
        near_one = np.ldexp(x, -self.power)
        self.centre = near_one.mean(0) if len(x) else np.zeros(x.shape[1])
        self.span = float(np.abs(near_one - self.centre).max()) if x.size else 1.0
        self.span = self.span or 1.0
        self.y = self.scaled(x)
        self.sq = (self.y**2).sum(1)
        top = int(level.max()) if len(level) else 0
        self.row = [np.cumsum(level >= k) - 1 for k in range(top + 1)]
        self.link = [np.full((int((level >= k).sum()), links * (1 if k else 2)), -1, np.int32) for k in range(top + 1)]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Vectors on the shard's own scale; infinite where they are beyond it."""
        with np.errstate(over="ignore"):
            return np.ascontiguousarray((np.ldexp(x, -self.power) - self.centre) / self.span, np.float32)

    def far(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of row i of ``q`` to nodes[i]; -1 is beyond all."""
        d = self.sq[nodes] - 2 * np.matmul(self.y[nodes], q[:, :, None])[:, :, 0]
        d += (q**2).sum(1)[:, None]
        return np.where(nodes < 0, _FAR, np.maximum(d, 0))

    def beam(self, level: int, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, nodes) of the ``ef`` nearest that the walk from ``start`` sees on a level, nearest first, for all rows of
        ``q`` at once: in each round every row opens its OPEN nearest nodes that aren't open yet."""
        b, n = len(q), len(self.level)
        link, row = self.link[level], self.row[level]
        nodes = np.full((b, ef), -1, np.int64)
        dist = np.full((b, ef), _FAR)
        nodes[:, : start.shape[1]] = start
        dist[:, : start.shape[1]] = self.far(q, start)
        order = np.argsort(dist, 1, kind="stable")
        nodes, dist = np.take_along_axis(nodes, order, 1), np.take_along_axis(dist, order, 1)
        opened = nodes < 0
        seen = np.zeros(b * n, bool)
        every = np.arange(b)[:, None]
        seen[(every * n + nodes)[nodes >= 0]] = True
        width = min(OPEN, ef)
        live = np.arange(b)
        square = (q**2).sum(1)
        while len(live):
            o = opened[live]
            at = np.argsort(o, 1, kind="stable")[:, :width]
            shut = np.take_along_axis(o, at, 1)
            pick = np.take_along_axis(nodes[live], at, 1)
            opened[live[:, None], at] = True
            near = link[row[np.where(shut, 0, pick)]].reshape(len(live), -1)
            near = np.where(np.repeat(shut, link.shape[1], 1), -1, near)
            r, c = np.nonzero(near >= 0)
            key = live[r] * n + near[r, c]
            key = key[~seen[key]]
            key.sort()
            key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
            seen[key] = True
            r, c = np.divmod(key, n)
            d = np.maximum(self.sq[c] - 2 * np.einsum("kd,kd->k", self.y[c], q[r]) + square[r], 0)
            good = d < dist[r, -1]
            r, c, d = r[good], c[good], d[good]
            if len(r):
                who, first, count = np.unique(r, return_index=True, return_counts=True)
                wide = int(count.max())
                place = np.arange(len(r)) - np.repeat(first, count)
                at = np.repeat(np.arange(len(who)), count)
                more_d, more_n = np.full((len(who), wide), _FAR), np.full((len(who), wide), -1, np.int64)
                more_d[at, place], more_n[at, place] = d, c
                all_d = np.concatenate((dist[who], more_d), 1)
                order = np.argsort(all_d, 1, kind="stable")[:, :ef]
                dist[who] = np.take_along_axis(all_d, order, 1)
                nodes[who] = np.take_along_axis(np.concatenate((nodes[who], more_n), 1), order, 1)
                opened[who] = np.take_along_axis(np.concatenate((opened[who], more_n < 0), 1), order, 1)
            live = live[~opened[live].all(1)]
        return dist, nodes

    def near(self, q: np.ndarray, ef: int) -> np.ndarray:
        """The nodes nearest to each row of ``q`` (scaled; -1: none), nearest first."""
        start = np.zeros((len(q), 1), np.int64)  # node 0 is on all levels
        for level in range(len(self.link) - 1, 0, -1):
            start = self.beam(level, q, start, 8)[1][:, :1]
        return self.beam(0, q, start, ef)[1]


def _spread(graph: Graph, dist: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Of candidates, nearest first, those nearer to the row's node than to any chosen before; then filled up with the
    nearest. All rows at once; -1: none."""
    b, m = nodes.shape
    v = graph.y[np.maximum(nodes, 0)]
    square = graph.sq[np.maximum(nodes, 0)]
    between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((b, m), bool)
    count = np.zeros(b, np.int64)
    for j in range(m):
        ok = (nodes[:, j] >= 0) & (count < most) & ~(chosen[:, :j] & (between[:, j, :j] < dist[:, j, None])).any(1)
        chosen[:, j] = ok
        count += ok
    rank = np.where(nodes < 0, 3 * m, np.arange(m) + np.where(chosen, 0, m))
    order = np.argsort(rank, 1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(rank, order, 1) >= 3 * m, -1, np.take_along_axis(nodes, order, 1))


def build(ids: np.ndarray, vectors: np.ndarray, links: int = LINKS, ef: int = BUILD) -> Graph:
    """The graph of a shard's rows. Its random order and levels depend on the number of distinct vectors alone."""
    x, inverse = np.unique(vectors, axis=0, return_inverse=True)
    n = len(x)
    rng = np.random.Generator(np.random.PCG64(n))
    enter = rng.permutation(n)  # node i is the vector enter[i]
    level = np.minimum((-np.log(np.maximum(rng.random(n), 1e-12)) / math.log(links)).astype(int), 12)
    if n:
        level[0] = level.max()
    number = np.empty(n, np.int64)
    number[enter] = np.arange(n)
    node = number[inverse.ravel()]
    order = np.lexsort((ids, node))
    g = Graph(x[enter], ids[order], np.concatenate(([0], np.cumsum(np.bincount(node, minlength=n)))), level, links)
    done = 1
    while done < n:
        size = min(max(16, done // 2), MOST, n - done, max(16, (64 << 20) // n))
        new = np.arange(done, done + size)
        q = g.y[new]
        start = np.zeros((size, 1), np.int64)
        own = g.sq[new][:, None] + g.sq[new][None] - 2 * (q @ q.T)
        np.fill_diagonal(own, _FAR)
        for lv in range(len(g.link) - 1, -1, -1):
            here = level[new] >= lv
            dist, found = g.beam(lv, q, start, ef if lv == 0 else min(ef, 32))
            start = found[:, : (4 if lv else 1)]
            if here.any():
                mine = np.flatnonzero(here)
                own_here = np.where(here[None, :], own[mine], _FAR)
                few = min(links, size)
                best = np.argpartition(own_here, few - 1, 1)[:, :few]
                d2 = np.maximum(np.take_along_axis(own_here, best, 1), 0)
                all_d = np.concatenate((dist[mine], d2.astype(np.float32)), 1)
                all_n = np.concatenate((found[mine], np.where(np.isinf(d2), -1, new[best])), 1)
                order = np.argsort(all_d, 1, kind="stable")[:, : max(ef, 3 * links)]
                all_d, all_n = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_n, order, 1)
                chosen = _spread(g, all_d[:, : 3 * links], all_n[:, : 3 * links], links)
                g.link[lv][g.row[lv][new[mine]], :links] = chosen
                _link_back(g, lv, new[mine], chosen)
        done += size
    return g


def _link_back(g: Graph, lv: int, new: np.ndarray, chosen: np.ndarray) -> None:
    """The chosen neighbours link to the new nodes; where a node has too many links, those spread best stay."""
    link, row = g.link[lv], g.row[lv]
    a, b = np.repeat(new, chosen.shape[1]), chosen.ravel()
    a, b = a[b >= 0], b[b >= 0]
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    who, first, count = np.unique(b, return_index=True, return_counts=True)
    wide = int(count.max()) if len(who) else 0
    if not wide:
        return
    more = np.full((len(who), wide), -1, np.int64)
    more[np.repeat(np.arange(len(who)), count), np.arange(len(b)) - np.repeat(first, count)] = a
    for k in range(0, len(who), 512):
        part = slice(k, k + 512)
        old = link[row[who[part]]].astype(np.int64)
        both = np.concatenate((old, more[part]), 1)
        both.sort(1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1  # a link that is there already
        dist = g.far(g.y[who[part]], both)
        order = np.argsort(dist, 1, kind="stable")[:, : 3 * link.shape[1]]
        dist, both = np.take_along_axis(dist, order, 1), np.take_along_axis(both, order, 1)
        full = (both >= 0).sum(1) > link.shape[1]
        keep = both[:, : link.shape[1]]
        if full.any():
            keep = keep.copy()
            keep[full] = _spread(g, dist[full], both[full], link.shape[1])
        if keep.shape[1] < link.shape[1]:
            keep = np.pad(keep, ((0, 0), (0, link.shape[1] - keep.shape[1])), constant_values=-1)
        link[row[who[part]]] = keep


_ARRAYS = {"x": np.float64, "ids": np.int64, "id_start": np.int64, "level": np.int64}


def pack(g: Graph) -> bytes:
    """Length and bytes of each array, the flat neighbour arrays last."""
    parts = [np.ascontiguousarray(getattr(g, c), t) for c, t in _ARRAYS.items()] + g.link
    head = np.array([g.x.shape[1], g.links, len(parts), *(p.size for p in parts)], np.int64)
    return b"".join([np.array([len(head)], np.int64).tobytes(), head.tobytes(), *(p.tobytes() for p in parts)])


def unpack(raw: bytes) -> Graph:
    head = np.frombuffer(raw, np.int64, int(np.frombuffer(raw, np.int64, 1)[0]), 8)
    at, parts = 8 + head.nbytes, []
    for i, size in enumerate(head[3:].tolist()):
        t = [*_ARRAYS.values()][i] if i < len(_ARRAYS) else np.int32
        parts.append(np.frombuffer(raw, t, size, at))
        at += parts[-1].nbytes
    x, ids, id_start, level = parts[:4]
    g = Graph(x.reshape(-1, int(head[0])), ids, id_start, level, int(head[1]))
    g.link = [p.reshape(table.shape) for p, table in zip(parts[4:], g.link)]
    return g


PARCEL = "dim int, shard long, slice int, part int, number int, payload binary"


def _build_group(key, frame: pd.DataFrame) -> pd.DataFrame:
    raw = pack(build(frame["vec_id"].to_numpy(np.int64), np.stack([np.frombuffer(v, np.float64) for v in frame["raw"]])))
    rows = [(key[0], key[1], i, raw[i * PIECE : (i + 1) * PIECE]) for i in range(-(-len(raw) // PIECE))]
    return pd.DataFrame(rows, columns=["dim", "shard", "number", "payload"])


def _raw_map(batches):
    """Vectors as bytes: (vec_id, dim, scale, raw)."""
    for batch in batches:
        column = batch.column("embedding")
        flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
        size = np.asarray(column.value_lengths())
        at = np.concatenate(([0], np.cumsum(size)))
        raw = pa.array([flat[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
        largest = np.maximum.reduceat(np.abs(flat), at[:-1]) if len(size) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(size.astype(np.int32)), pa.array(scale_of(largest)), raw], ["vec_id", "dim", "scale", "raw"])


def _block_group(key, frame: pd.DataFrame) -> pd.DataFrame:
    """A block of queries as one row: their ids, then their vectors."""
    ids = frame["vec_id"].to_numpy(np.int64)
    rows = []
    for k in range(0, len(ids), BLOCK):
        part = frame["raw"].iloc[k : k + BLOCK]
        rows.append((key[0], key[1], len(part), ids[k : k + BLOCK].tobytes() + b"".join(part)))
    return pd.DataFrame(rows, columns=["dim", "block", "number", "payload"])


def _found(g: Graph, ids: np.ndarray, vectors: np.ndarray, k: int, ef: int):
    """(query, distance, id) of the k nearest rows of a shard to each query, nearest first, ties to smaller ids."""
    if not len(g.level):
        return
    step = max(1, min(256, (64 << 20) // len(g.level)))
    for a in range(0, len(ids), step):
        part = g.scaled(vectors[a : a + step])
        walks = (np.abs(part) <= BEYOND).all(1)
        found = iter(g.near(part[walks], max(ef, k + 1)))
        for q, v, walk in zip(ids[a : a + step].tolist(), vectors[a : a + step], walks.tolist()):
            if walk:
                own = next(found)
                own = own[own >= 0]
                d = distances(g.x[own], v)
            else:  # all nodes as near as the k + 1st stay, as there may be ties; those of least ids are chosen below
                d = distances(g.x, v)
                own = np.flatnonzero(d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)])
                d = d[own]
            order = np.argsort(d, kind="stable")[: k + 1]  # a node has an id at least, and the query's own may be one
            kth = d[order[-1]]
            got = []
            own, d = own[d <= kth], d[d <= kth]
            if len(own) > 4 * (k + 1):  # many ties: those whose least ids are least come first
                least = np.lexsort((g.ids[g.id_start[own]], d))[: 2 * (k + 1)]
                own, d = own[least], d[least]
            for n, e in zip(own.tolist(), d.tolist()):
                same = g.ids[g.id_start[n] : g.id_start[n + 1]]
                got += [(e, i) for i in same[same != q][:k].tolist()]  # no more than k of equal vectors can be among the k nearest
            for e, i in sorted(got)[:k]:
                yield q, e, i


def _search_map(k: int, ef: int):
    def run(batches):
        shard, pieces, g = None, [], None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("dim", "shard", "slice", "part", "number")), batch.column("payload"))
            for dim, s, piece, part, number, payload in rows:
                if (dim, s, piece) != shard:
                    shard, pieces, g = (dim, s, piece), [], None
                raw = payload.as_buffer()
                if part == 0:
                    pieces.append(raw.to_pybytes())
                    continue
                if g is None:
                    g, pieces = unpack(b"".join(pieces)) if pieces else None, []
                if g is None:
                    continue
                ids = np.frombuffer(raw, np.int64, number)
                vectors = np.frombuffer(raw, np.float64, number * dim, 8 * number).reshape(-1, dim)
                got = list(_found(g, ids, vectors, k, ef))
                if got:
                    q, d, i = zip(*got)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.float64()), pa.array(i, pa.int64())], ["query_id", "score", "vec_id"])

    return run


def _best_group(k: int):
    """The k best of each query among the results of some shards."""

    def run(batches):
        held, size = [], 0

        def best(parts):
            t = pa.Table.from_batches(parts)
            q, d, i = (t.column(c).to_numpy() for c in ("query_id", "score", "vec_id"))
            order = np.lexsort((i, d, q))
            q = q[order]
            first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            keep = order[rank < k]
            return pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[keep]) for c in ("query_id", "score", "vec_id")] + [pa.array((rank[rank < k] + 1).astype(np.int32))], ["query_id", "score", "vec_id", "rank"])

        for batch in batches:
            held.append(batch.select(["query_id", "score", "vec_id"]))
            size += batch.num_rows
            if size > 500_000:  # what is held shrinks to the best so far
                held = [best(held).select(["query_id", "score", "vec_id"])]
                size = held[0].num_rows
        if size:
            yield best(held)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles, dim) of rows whose vector is whole: not null, empty or zero, all components finite."""
    v = F.col("embedding").cast("array<double>")
    ok = F.coalesce(F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return vectors.where(ok).select(F.col("vec_id").cast("long"), v.alias("embedding"), F.size(v).alias("dim"))


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, ef: int = SEARCH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k`` rows of ``vectors`` nearest by Euclidean
    distance, without the row of its own id; ties go to smaller ids; fewer where there are fewer.

    Rows with unusable vectors (null, empty, zero, with a component null or not finite) and null ids take no part on either
    side; components may have any exponent; vectors meet only those of their own length. Repeated rows of
    ``vectors`` count each, those of ``queries`` once; other columns play no part; empty tables give no rows."""
    scratch = Scratch(spark, "hnsw")
    raw = lambda t: usable(t).select("vec_id", "embedding").mapInArrow(_raw_map, "vec_id long, dim int, scale int, raw binary")
    rows, asked = raw(vectors), raw(queries.dropDuplicates(["vec_id"]))
    blocks = max(1, -(-queries.count() // BLOCK))
    # a row for each length and magnitude there is: its number of shards, and the number of its first
    classes = rows.groupBy("dim", "scale").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    classes = scratch.cut(classes.withColumn("base", F.coalesce(F.sum("shards").over(Window.orderBy("dim", "scale").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    n, shards = classes.agg(F.count("*"), F.coalesce(F.sum("shards"), F.lit(0))).first()
    dealt = rows.join(F.broadcast(classes) if n <= FEW else classes, ["dim", "scale"]).withColumn("shard", F.col("base") + F.pmod(F.xxhash64("vec_id", "raw"), F.col("shards")))
    index = scratch.cut(dealt.groupBy("dim", "shard").applyInPandas(_build_group, "dim int, shard long, number int, payload binary"))
    block = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInPandas(_block_group, "dim int, block int, number int, payload binary")
    slices = -(-blocks // BLOCKS)  # a copy of the graph for each
    graphs = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("part"), "number", "payload")
    block = scratch.cut(block)
    every = classes.select("dim", F.explode(F.sequence("base", F.col("base") + F.col("shards") - 1)).alias("shard"))
    spread = block.join(every, "dim").select("dim", "shard", (F.col("block") % slices).alias("slice"), F.lit(1).alias("part"), "number", "payload")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), shards * slices))
    stream = graphs.unionByName(spread).repartitionById(parts, F.pmod(F.col("shard") * slices + F.col("slice"), F.lit(parts)).cast("int")).sortWithinPartitions("dim", "shard", "slice", "part", "number")
    found = stream.mapInArrow(_search_map(k, ef), "query_id long, score double, vec_id long")
    best = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query_id").mapInArrow(_best_group(k), "query_id long, score double, vec_id long, rank int")
    return best.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(spark, vectors, vectors.where("vec_id % 100 = 0"))
