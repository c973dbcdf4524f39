"""Searches in supersteps against the kernels, and what a judge is asked."""

import collections
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyframe.operators import judge as J
from keyframe.operators import select as C
from keyframe.operators import supersteps as P


def clips(spark, n=7, frames=60):
    rng = np.random.default_rng(7)
    rows = []
    for v in range(n):
        scene = np.sort(rng.integers(0, 9, frames + v))
        base = rng.random((9, 6))
        rows.append((v, (base[scene] + 0.02 * rng.random((len(scene), 6))).tolist(), rng.integers(40, 200, len(scene)).astype(float).tolist(), rng.integers(0, 999, len(scene)).astype(float).tolist()))
    return spark.createDataFrame([*rows, (99, [[1.0, 2.0]], [3.0], [4.0])], "video long, hist array<array<double>>, sharp array<double>, value array<double>")


def logged(path):
    """A judge that leaves a line for each prompt in a file, as workers are other processes."""
    judge = P.arithmetic()

    def ask(prompts):
        with open(path, "a") as f:
            f.writelines(p.replace("\n", " ") + "\n" for p in prompts)
        return judge(prompts)

    return ask


def lines(path):
    return collections.Counter(open(path).read().splitlines())


def rows_of(df):
    return sorted((r.video, r.q, r.frames, r.steps, r.forced, r.reason) for r in df.collect())


@pytest.mark.parametrize("method", ["capped", "guided", "agent", "cluster", "uniform"])
def test_supersteps_like_kernels(spark, tmp_path, method):
    c = clips(spark)
    items = c.select("video", F.explode(F.array(F.lit(3), F.lit(11))).alias("q"))
    want = rows_of(C.choose(items.join(c, "video"), method, "q"))
    log = tmp_path / "log"
    log.touch()
    got = P.run(spark, items, c, method, "q", f"file://{tmp_path}/run", logged(str(log)))
    assert rows_of(got) == want and len(want) == 16
    assert all(n == 1 for n in lines(log).values()) and (len(lines(log)) > 10 or method == "uniform")


def test_supersteps_go_on(spark, tmp_path):
    """A judge that breaks the run; the next one starts at the last whole step and asks nothing again."""
    c = clips(spark, 4)
    items = c.select("video", F.lit(5).alias("q"))
    store, log, n = f"file://{tmp_path}/run", tmp_path / "log", 0
    log.touch()
    with pytest.raises(ValueError, match="broken"):
        real = P.J.ask

        def some(rows, judge, *a, **k):
            nonlocal n
            n += 1
            if n == 4:
                raise ValueError("broken")
            return real(rows, judge, *a, **k)

        P.J.ask = some
        try:
            P.run(spark, items, c, "capped", "q", store, logged(str(log)))
        finally:
            P.J.ask = real
    before = lines(log)
    got = P.run(spark, items, c, "capped", "q", store, logged(str(log)))
    assert rows_of(got) == rows_of(C.choose(items.join(c, "video"), "capped", "q"))
    after = lines(log)
    assert before and all(after[k] == 1 for k in after) and set(before) < set(after)
    n_lines = sum(after.values())
    assert rows_of(P.run(spark, items, c, "capped", "q", store, logged(str(log)))) == rows_of(got) and sum(lines(log).values()) == n_lines


@pytest.mark.parametrize("strategy", ["bfs", "gbfs", "dijkstra", "adaptive"])
def test_strategies_in_words(strategy):
    """A judge that reads the request chooses as the strategy does that sees the values."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        value = rng.integers(0, 50, 90).astype(float)
        sample = sorted({0, 89, *rng.choice(90, 6, replace=False).tolist()})
        segments = list(zip(sample, sample[1:]))
        able = [i for i, s in enumerate(segments) if s[1] - s[0] > 1]
        known = {}
        told = P.Told(value, 4, known)
        with pytest.raises(P.Open) as e:
            told.pick(sample, segments, able)
        known[P.digest(str(e.value))] = P.arithmetic(strategy)([str(e.value)])[0]
        assert sorted(told.pick(sample, segments, able)) == sorted(C.Look(value, 4, strategy).pick(sample, segments, able))


def test_supersteps_bound(spark, tmp_path):
    c = clips(spark, 3)
    got = P.run(spark, c.select("video", F.lit(1).alias("q")), c, "capped", "q", f"file://{tmp_path}/run", P.arithmetic(), most=2)
    assert {r.reason for r in got.collect()} >= {"open", "short"} and got.count() == 4


@pytest.mark.parametrize("method", ["capped", "guided", "agent", "cluster"])
def test_packed_like_rows(spark, method):
    c = clips(spark, 3)
    items = c.select("video", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("q"), F.lit("x").alias("frames_"))
    want = rows_of(C.choose(items.join(c, "video"), method, "q"))
    assert rows_of(C.choose_packed(items, c, method, "q", pack=4)) == want


def test_calls_in_order_and_bounded():
    running, most, taken, lock = 0, 0, 0, threading.Lock()

    def call(x):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.002 * (x % 3))
        with lock:
            running -= 1
        return -x

    def work():
        nonlocal taken
        for x in range(60):
            taken += 1
            yield x

    seen = 0
    for x, reply in J.in_order(work(), call, 5):
        assert (x, reply) == (seen, -seen) and taken <= seen + 5
        seen += 1
    assert seen == 60 and 2 <= most <= 5


def test_one_bad_prompt_alone_is_empty(spark):
    def judge(prompts):
        if any("bad" in p for p in prompts):
            raise OSError("no")
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(i, "bad" if i == 57 else f"p{i}") for i in range(200)], "i int, prompt string").coalesce(1)
    got = J.ask(rows, judge, tries=2).collect()
    assert [r.i for r in got] == list(range(200)) and {r.i for r in got if not r.reply} == {57}


def test_cache_keys_that_repeat(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "i int, prompt string")
    cache = rows.where("i = 1").select(F.sha2("prompt", 256).alias("key"), F.lit("C").alias("reply"))
    assert J.cached(rows, cache.unionByName(cache).unionByName(cache.withColumn("reply", F.lit("D"))))[0].count() == 2


def test_steps_shuffle_no_features(spark, tmp_path):
    """Features are read in buckets, also by a run that goes on; the one exchange is that of the open rows."""
    c, store = clips(spark, 5), f"file://{tmp_path}/run"
    for name in ("features_a", "features_b"):
        table = P.bucketed(spark, store, "video", name, lambda: c)
        joined = table.join(c.select("video").hint("shuffle_hash"), "video")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
        assert sorted(r.video for r in joined.collect()) == [0, 1, 2, 3, 4, 99]
        spark.sql(f"DROP TABLE {name}")


def test_replies_in_order():
    """Replies go by order: a request that comes again in an attempt has its own, one beyond the last has none."""
    told = P.Told(np.arange(9.0), 1, P.Replies(["2", "3"]))
    assert [told.sure([1]), told.sure([2]), told.sure([1])] == [2, 3, 2]
    with pytest.raises(P.Open):
        told.sure([3])


def test_packed_methods_together(spark):
    """Several methods take one pass over the features and give what each of them gives alone."""
    c = clips(spark, 3)
    items = c.select("video", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("q"))
    got = C.choose_packed(items, c, ["capped", "cluster"], "q", pack=4)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    for m in ("capped", "cluster"):
        assert rows_of(got.where(F.col("method") == m)) == rows_of(C.choose_packed(items, c, m, "q"))
