"""Searches in supersteps, for judges that are asked over a network: all videos go forward together, and a step of all of
them asks what they need to know as one table of prompts.

A row is a video and a question. A step runs the row's method on the replies that are known. Where the method needs one
that isn't, the attempt ends with a request; requests of all rows are asked once by their text, replies are kept, and
the next step goes on with them, as methods do nothing but what replies tell them. Rows that are done leave. The state
of each step is a written table: replies by digest, the open request, or the frames. So a run that breaks off starts
again with its last whole step, and no prompt that was answered is asked again.

The state grows by a reply a step, not by frames or requests: replies stand in the order in which the method asks for them.
Features are written once, in buckets by part, which open rows are sent to: a step shuffles no features."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyframe.streaming import shared

from . import judge as J
from . import select as C
from . import video as V
from .search import coverage, longest

FOUND = "known array<string>, request string, digest binary, frames array<int>, steps int, forced int, reason string"


class Open(Exception):
    """A request without a reply."""


def digest(request: str) -> str:
    return hashlib.md5(request.encode()).hexdigest()


def numbers(reply: str) -> list[int]:
    return [int(x) for x in re.findall(r"-?\d+", reply)]


class Replies:
    """Replies in the order of the requests that they were given to, by digest: a method that starts anew asks the same ones,
    so each request that is new to an attempt has the next reply."""

    def __init__(self, replies: list[str]):
        self.left, self.seen = iter(replies), {}

    def __getitem__(self, key: str) -> str:
        if key not in self.seen:
            try:
                self.seen[key] = next(self.left)
            except StopIteration:
                raise KeyError(key) from None
        return self.seen[key]


class Told:
    """The choices of a method as requests in words, and what replies to them mean."""

    def __init__(self, value: np.ndarray, question: int, known: dict[str, str] | Replies):
        self.value, self.question, self.known = value, question, known

    def _reply(self, role: str, text: str) -> str:
        request = f"{role} for question {self.question}: {text}"
        try:
            return self.known[digest(request)]
        except KeyError:
            raise Open(request) from None

    def pick(self, sample, segments, able) -> list[int]:
        """Segments are described by their frames, the change between these and the highest value between."""
        rows = []
        for i in able:
            a, b = segments[i]
            inner = self.value[a + 1 : b]
            rows.append(f"{i}) {a} to {b}, change {float(abs(self.value[b] - self.value[a]))!r}, highest {float(inner.max()) if len(inner) else -1.0!r}")
        return [i for i in numbers(self._reply("Choose segments", "; ".join(rows))) if i in able]

    def relevant(self, frame: int) -> bool:
        return self._reply("Is the frame relevant", f"{frame}, value {float(self.value[frame])!r}").strip().lower().startswith("yes")

    def sure(self, sample) -> int:
        found = numbers(self._reply("How sure are you", ", ".join(map(str, sample))))
        return min(3, max(1, found[0])) if found else 1

    def ask(self, sample) -> list[tuple[int, int]]:
        found = numbers(self._reply("Which frames are missing", ", ".join(map(str, sample))))
        return list(zip(found[::2], found[1::2]))

    def relevance(self, rows) -> list[int]:
        found = numbers(self._reply("How relevant are the frames", ", ".join(f"{r} (value {float(self.value[r])!r})" for r in rows)))
        return [min(3, max(1, x)) for x in found[: len(rows)]] + [1] * (len(rows) - len(found))


def _step_map(method: Callable, keys: list[str], question: str, found: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, s, v, q, known in zip(*(batch.column(c) for c in ("hist", "sharp", "value", question, "known"))):
                known, request = known.as_py() or [], None
                try:
                    got = method(V.Clip(C.matrix(h), C.vector(s)), Told(C.vector(v), int(q.as_py()), Replies(known)))
                except Open as e:
                    request, got = str(e), {"sample": [], "reason": "open"}
                except Exception as e:  # noqa: BLE001  a method may raise anything
                    got = {"sample": [], "reason": f"error: {type(e).__name__}"}
                out.append({"known": known if request else [], "request": request, "digest": bytes.fromhex(digest(request)) if request else None, **C.found(got)})
            made = pa.Table.from_pylist(out, found).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in made.columns)], [*keys, *found.names])

    return run


def bucketed(spark: SparkSession, store: str, part: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a run in buckets by ``part``, a file each, so that joins by it move the other side only; made and written
    only where that hasn't been done to the end. The number of buckets is kept in the folder's name; ``name`` is the session's
    for it."""
    done = [x for x in shared.names(spark, store) if re.fullmatch(r"features-\d+", x) and shared.written(spark, f"{store}/{x}")]
    if not done:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        shared.remove(spark, f"{store}/features-{n}")
        make().repartition(n, part).write.bucketBy(n, part).option("path", f"{store}/features-{n}").saveAsTable(name)
        return spark.table(name)
    n, path = done[0].split("-")[1], f"{store}/{done[0]}"
    columns = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{part}`) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def run(spark: SparkSession, items: DataFrame, clips: DataFrame, method: str, question: str, store: str, judge: J.Judge, part: str = "video", most: int = 500, methods: dict[str, Callable] | None = None) -> DataFrame:
    """``items`` (part, question, other columns) with frames, steps, forced and reason, as ``select.choose`` gives them.

    ``clips``: features by part. ``store``: a folder of this run; given again, the run goes on where it was. A row that
    isn't done after ``most`` steps has no frames and the reason open."""
    one = (methods or C.METHODS)[method]
    keys = items.columns
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in items.schema) + ", " + FOUND
    found = pa.schema([("known", pa.list_(pa.string())), ("request", pa.string()), ("digest", pa.binary()), *C.CHOSEN])
    name = f"features_{uuid.uuid4().hex}"
    features = bucketed(spark, store, part, name, lambda: clips)

    def stepped(rows: DataFrame) -> DataFrame:
        # open rows are the hashed side, so that features aren't sorted either
        return features.join(rows.hint("shuffle_hash"), part).mapInArrow(_step_map(one, keys, question, found), schema)

    state = lambda n: f"{store}/state-{n:04d}"
    done = [n for n in shared.names(spark, store) if n.startswith("state-") and shared.written(spark, f"{store}/{n}")]
    n = len(done) - 1
    if n < 0:
        n = 0
        stepped(items.withColumn("known", F.lit(None).cast("array<string>"))).write.mode("overwrite").parquet(state(0))
    for n in range(n, most):
        rows = spark.read.parquet(state(n)).where("request is not null")
        if not rows.limit(1).count():
            break
        cache = [f"{store}/replies-{i:04d}" for i in range(n)]
        kept = spark.read.parquet(*cache) if cache else spark.createDataFrame([], "digest binary, reply string")
        fresh = rows.select("digest", F.col("request").alias("prompt")).dropDuplicates(["digest"]).join(kept, "digest", "left_anti")
        new = shared.once(spark, f"{store}/replies-{n:04d}", lambda fresh=fresh: J.ask(fresh, judge).select("digest", "reply"))
        told = rows.join(kept.unionByName(new), "digest")
        told = told.select(*keys, F.array_append(F.coalesce("known", F.array().cast("array<string>")), F.col("reply")).alias("known"))
        stepped(told).write.mode("overwrite").parquet(state(n + 1))
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files stay
    last = max(i for i in range(most + 1) if shared.written(spark, state(i)))
    ended = spark.read.parquet(*(state(i) for i in range(last + 1))).where("request is null")
    left = spark.read.parquet(state(last)).where("request is not null")
    return ended.unionByName(left).select(*keys, "frames", "steps", "forced", "reason")


def arithmetic(strategy: str = "a_star", level: float = 40.0) -> J.Judge:
    """A judge that answers from the numbers in a request alone, as ``select.Look`` does from the values; for tests and for
    queries without a model."""
    import zlib

    def pick(text: str) -> str:
        rows = [(int(i), int(a), int(b), float(c), float(h)) for i, a, b, c, h in re.findall(r"(\d+)\) (\d+) to (\d+), change (\S+), highest ([^;\s]+)", text)]
        mean = sum(r[2] - r[1] for r in rows) / max(1, len(rows))
        worth = {"gbfs": lambda r: r[4], "dijkstra": lambda r: r[3], "a_star": lambda r: r[4] + r[3], "adaptive": lambda r: r[4] + r[3]}
        if strategy == "bfs":
            best = longest([(r[1], r[2]) for r in rows], 3)
            return ", ".join(str(next(r[0] for r in rows if (r[1], r[2]) == s)) for s in best)
        need = lambda r: coverage(r[1:3], mean) if strategy == "adaptive" else 0
        return str(min(rows, key=lambda r: (need(r), -worth[strategy](r), r[1]))[0]) if rows else ""

    def one(prompt: str) -> str:
        role, q, text = re.match(r"(.*?) for question (-?\d+): (.*)", prompt, re.S).groups()
        q = int(q)
        if role == "Choose segments":
            return pick(text)
        if role == "Is the frame relevant":
            return "yes" if (float(text.split("value ")[1]) + q) % 97 >= level / 4 else "no"
        sample = numbers(text)
        if role == "How sure are you":
            return str(1 + zlib.crc32(repr((q, sample)).encode()) % 3)
        if role == "Which frames are missing":
            segments = V.segments_of(sample)
            wide = V.longest(segments)
            return "" if wide is None else f"{wide} {segments[wide][0] + q % max(1, segments[wide][1] - segments[wide][0])}"
        return ", ".join(str(1 + int(float(v) + q) % 3) for v in re.findall(r"value ([^)]+)\)", text))

    return lambda prompts: [one(p) for p in prompts]
