"""Operators on ordered frames and steps: histories, gaps, samples, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history(steps: DataFrame, part: list[str], order: list[str], text: str, k: int) -> DataFrame:
    """The previous k texts, numbered, or "None". Filter afterwards: dropped steps still count as history."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(-k, -1)
    last = F.collect_list(text).over(w)
    return steps.withColumn("history", F.when(F.size(last) == 0, "None").otherwise(F.array_join(F.transform(last, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")))


def gaps(frames: DataFrame, part: str, at: str) -> DataFrame:
    """(part, start, end, gap) between neighbours."""
    nxt = F.lead(at).over(Window.partitionBy(part).orderBy(at))
    return frames.select(part, F.col(at).alias("start"), nxt.alias("end")).where("end is not null").withColumn("gap", F.col("end") - F.col("start"))


def coverage(frames: DataFrame, part: str, at: str, imbalance: int = 3) -> DataFrame:
    """Largest gap (first of equals), mean gap, whether it is out of balance, and the number of sparse gaps."""
    g = gaps(frames, part, at)
    tot = g.groupBy(part).agg(F.count("*").alias("n"), F.sum("gap").alias("total"), F.max(F.struct("gap", (-F.col("start")).alias("s"), "end")).alias("m"), F.collect_list("gap").alias("all"))
    return tot.select(part, "n", F.round(F.col("total") / F.col("n"), 6).alias("avg_gap"), F.col("m.gap").alias("max_gap"), (-F.col("m.s")).alias("max_start"), F.col("m.end").alias("max_end"), (F.col("m.gap") * F.col("n") > imbalance * F.col("total")).alias("imbalanced"), F.size(F.filter("all", lambda x: x * F.col("n") > 2 * F.col("total"))).alias("n_sparse"))


def linspace(n: Column, k: int) -> Column:
    """k whole indices from 0 to n - 1, all if there are no more than k."""
    return F.when(n <= k, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1)).cast("int")))


def rounded(n: Column, k: int) -> Column:
    """As linspace, rounded half to even."""
    return F.when(n <= k, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / (k - 1)).cast("int")))


def stride(n: Column, k: int) -> Column:
    return F.when(n <= k, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * n / k).cast("int")))


def clock(idx: Column, fps: int) -> Column:
    """mm:ss:ff of a frame."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    sec = F.floor(idx / fps).cast("int")
    return F.concat_ws(":", two(F.floor(sec / 60).cast("int")), two(sec % 60), two(idx % fps))


def split(segments: DataFrame, chosen: str, mode: str) -> DataFrame:
    """Halve chosen segments of two frames or more; ``retain`` keeps the others, ``prune`` drops them, ``merge`` joins
    runs of them. ``segments``: video, start, end, and a boolean column ``chosen``."""
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    halves = F.when(F.col(chosen) & (F.col("end") - F.col("start") > 1), F.array(F.struct("start", mid.alias("end")), F.struct(mid.alias("start"), "end"))).otherwise(F.array(F.struct("start", "end")))
    if mode == "prune":
        segments = segments.where(chosen)
    if mode == "merge":
        w = Window.partitionBy("video").orderBy("start")
        run = F.sum(F.when(F.col(chosen) | F.coalesce(F.lag(chosen).over(w), F.lit(True)), 1).otherwise(0)).over(w)
        segments = segments.withColumn("run", run).groupBy("video", "run", chosen).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return segments.select("video", F.explode(halves).alias("s")).select("video", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def stable_suffix(frames: DataFrame, part: str, at: str, sim: str, least: float) -> DataFrame:
    """First index of the run at the end whose similarity to the end stays at ``least`` or more."""
    w = Window.partitionBy(part).orderBy(F.desc(at))
    ok = F.min((F.col(sim) >= least).cast("int")).over(w)
    return frames.withColumn("ok", ok).where("ok = 1").groupBy(part).agg(F.min(at).alias("stable_from"))


def trim(frames: DataFrame, part: str, at: str, relevant: str) -> DataFrame:
    """Bounds of the relevant frames; the whole range where none is."""
    return frames.groupBy(part).agg(F.coalesce(F.min(F.when(F.col(relevant), F.col(at))), F.min(at)).alias("lo"), F.coalesce(F.max(F.when(F.col(relevant), F.col(at))), F.max(at)).alias("hi"))


def positions(df: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """``df`` with pos, the place of each row from 0 by the distinct number ``key``. Rows are dealt by quantiles of the key,
    so no task sorts them all; what is broadcast is a count for each of ``parts`` ranges."""
    bounds = df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    ranged = df.withColumn("part_", F.aggregate(F.array(*map(F.lit, sorted(set(bounds)))).cast("array<double>"), F.lit(0), lambda n, b: n + (F.col(key) > b).cast("int")) if bounds else F.lit(0))
    count = ranged.groupBy("part_").agg(F.count("*").alias("n_"))
    before = count.select("part_", (F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before_"))
    r = F.row_number().over(Window.partitionBy("part_").orderBy(key)) - 1
    return ranged.withColumn("r_", r).join(F.broadcast(before), "part_").withColumn("pos", F.col("r_") + F.col("before_")).drop("part_", "r_", "before_")


def jump_bounds(frames: DataFrame, part: str, at: str, relevant: str, jump: int) -> DataFrame:
    """(part, lo, hi): bounds of the content found by jumps over irrelevant frames from either end, never past each other.
    Frames count from 0 without holes."""
    n = frames.groupBy(part).agg(F.count("*").cast("int").alias("n"))
    head = frames.join(n, part).where((F.col(at) % jump == 0) & (F.col(at) <= F.col("n") - 1 - jump) & F.col(relevant)).groupBy(part).agg(F.min(at).alias("found"))
    past = lambda room: F.floor(room / jump + 1).cast("int") * jump
    room = F.col("n") - 1 - jump
    low = n.join(head, part, "left").select(part, "n", F.coalesce("found", F.when(room < 0, 0).otherwise(past(room))).alias("lo"))
    tail = frames.join(low, part).where(((F.col("n") - 1 - F.col(at)) % jump == 0) & (F.col(at) >= F.col("lo") + jump) & F.col(relevant)).groupBy(part).agg(F.max(at).alias("found"))
    room = F.col("n") - 1 - F.col("lo") - jump
    return low.join(tail, part, "left").select(part, "lo", F.coalesce("found", F.when(room < 0, F.col("n") - 1).otherwise(F.col("n") - 1 - past(room))).alias("hi"))


def replaced(frames: DataFrame, part: str, at: str, relevant: str, sample: Column, new: Column, tries: int = 5) -> DataFrame:
    """(part, from_idx, to_idx): a new frame itself if relevant, else the nearest relevant one on a grid between its
    neighbours in the sample, to the right first, else null. ``sample`` and ``new`` tell which frames are which."""
    s = frames.groupBy(part).agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.when(sample, F.col(at)))).alias("s"))
    f = frames.where(new).select(part, F.col(at).alias("from_idx"), F.col(relevant).alias("ok")).join(s, part)
    left = F.coalesce(F.array_max(F.filter("s", lambda x: x < F.col("from_idx"))) + 1, F.lit(0))
    right = F.coalesce(F.array_min(F.filter("s", lambda x: x > F.col("from_idx"))) - 1, F.col("n") - 1)
    f = f.withColumn("l", left).withColumn("r", right).withColumn("step", F.greatest(F.lit(5), F.floor((F.col("r") - F.col("l")) / 10).cast("int")))
    grid = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda k: F.array(F.struct((2 * k).alias("o"), (F.col("from_idx") + k * F.col("step")).alias("to")), F.struct((2 * k + 1).alias("o"), (F.col("from_idx") - k * F.col("step")).alias("to")))))
    able = F.filter(grid, lambda g: g["to"].between(F.col("l"), F.col("r")) & ~F.array_contains("s", g["to"]))
    tried = f.where(~F.col("ok")).select(part, "from_idx", F.explode(able).alias("g")).select(part, "from_idx", "g.*")
    hit = tried.join(frames.where(relevant).select(part, F.col(at).alias("to")), [part, "to"]).groupBy(part, "from_idx").agg(F.min(F.struct("o", "to")).alias("m"))
    out = f.select(part, "from_idx", "ok").join(hit, [part, "from_idx"], "left")
    return out.select(part, "from_idx", F.when(F.col("ok"), F.col("from_idx")).otherwise(F.col("m.to")).alias("to_idx"))


def overriding(base: DataFrame, only=None, rerun: DataFrame | None = None, avoid=(), listed: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Ids to work on; of the rules given, a later one overrides those before it: the base, those of ``only`` that are in it,
    those of a log to run again, without the avoided ones; a list overrides all."""
    ids = base.select(key)
    if only is not None:
        ids = ids.where(F.col(key).isin(*only))
    if rerun is not None:
        ids = rerun.select(key)
    if avoid:
        ids = ids.where(~F.col(key).isin(*avoid))
    return listed.select(key) if listed is not None else ids
