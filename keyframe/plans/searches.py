"""Queries that run searches and judges."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import functions as F

from keyframe.functions import answers as N
from keyframe.operators import judge as J
from keyframe.operators import search as S
from keyframe.operators import select as C
from keyframe.operators import supersteps as P
from keyframe.operators import timeline as T
from keyframe.operators import video as V
from keyframe.sources.checkpoint import Checkpoint
from keyframe.streaming import resume, shared

from . import surrogates as X


def force_fill(spark, d):
    return S.force_fill(X.frames(spark, d).select("video", "idx"))


def _tree(strategy):
    def run(spark, d):
        return S.tree_search(X.frames(spark, d).select("video", "idx", "v"), strategy)

    return run


def _clips(spark, d):
    """A row per video: four numbers of a frame stand for its histogram, twice its number k for its sharpness."""
    v, k = F.col("v"), F.col("k")
    hist = [v % 97, F.floor(v / 7) % 89, k, (k * 3) % 50, F.floor(v / 1000)]
    return C.clips(X.frames(spark, d), "video", "idx", hist, k * 2, v)


def _search(method, question="video"):
    def run(spark, d):
        rows = _clips(spark, d).withColumn("question", F.col(question))
        got = C.choose(rows, method, "question")
        return got.select("video", F.posexplode("frames").alias("pos", "frame"), "steps", "forced", "reason")

    return run


def _steps(method):
    """The frames of a search whose every choice is asked for in words, all videos a step at a time."""

    def run(spark, d):
        clips = _clips(spark, d)
        items = clips.select("video", F.col("video").alias("question"))
        got = P.run(spark, items, clips, method, "question", f"{shared.folder(spark)}/steps-{uuid.uuid4().hex}", P.arithmetic())
        return got.select("video", F.posexplode("frames").alias("pos", "frame"), "steps", "forced", "reason")

    return run


def split_point(spark, d):
    """The split point of each segment of an even sample of five frames."""

    def points(hist, sharp):
        import numpy as np

        clip = V.Clip(np.stack(list(hist)), sharp)
        return [(a, b, V.split_point(clip, (a, b))) for a, b in V.segments_of(V.spaced(clip.n, 5))]

    def run(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame([(v, *p) for v, h, s in zip(f["video"], f["hist"], f["sharp"]) for p in points(h, s)], columns=["video", "seg_start", "seg_end", "split_at"])

    return _clips(spark, d).select("video", "hist", "sharp").mapInPandas(run, "video long, seg_start int, seg_end int, split_at int")


def adaptive_breadth(spark, d):
    """Clusters, representatives and high relevances of each video."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            rows = []
            for v, h, value in zip(f["video"], f["hist"], f["value"]):
                look = C.Look(np.asarray(value), int(v))
                _, score, nodes, k = V.wide_enough(np.stack(list(h)), look.relevance, seed=int(v))
                rows.append((v, k, len(nodes), sum(x == 3 for x in score.values())))
            yield pd.DataFrame(rows, columns=["video", "clusters", "n_nodes", "n_high"])

    return _clips(spark, d).select("video", "hist", "value").mapInPandas(run, "video long, clusters int, n_nodes int, n_high int")


def kept_frames(spark, d):
    """Frames that repeat none of those kept before them, by likeness over REPEATS."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            out = [(v, i) for v, h, s in zip(f["video"], f["hist"], f["sharp"]) for i in V.first_kept(V.Clip(np.stack(list(h)), s))[0]]
            yield pd.DataFrame(out, columns=["video", "frame"])

    return _clips(spark, d).select("video", "hist", "sharp").mapInPandas(run, "video long, frame int")


def _prompts(spark, d, frames: bool):
    q = X.qa(spark, d)
    at = F.array_join(F.transform(T.linspace(F.col("n_chars"), 8), lambda i: i.cast("string")), ",") if frames else F.lit("")
    return q.select("qid", "truth", "lang", F.concat_ws("|", F.lit("Q"), "qid", "source", at).alias("prompt"))


def _judged(spark, d, frames):
    return J.ask(_prompts(spark, d, frames)).select("qid", "truth", "lang", N.parse_letter(F.col("reply")).alias("pred"))


def judge_batch(spark, d):
    return _judged(spark, d, True).select("qid", "pred")


def _items(spark, d):
    """Questions about videos: the number of a question picks one of the videos there are."""
    videos = X.frames(spark, d).select("video").distinct()
    ranked = T.positions(videos, "video").withColumnRenamed("pos", "slot")
    q = X.qa(spark, d).withColumn("slot", F.pmod(F.col("qid"), F.lit(max(videos.count(), 1))))
    return q.join(ranked, "slot").select("qid", "truth", "lang", "type", "source", "video"), _clips(spark, d)


def _chosen(items, clips, methods: list[str]):
    """Frames by each of some methods. Features go to those methods only that look at them, to all of these at once: no frames need
    none, and spaced ones the number of frames."""
    made = {"steps": F.lit(0), "forced": F.lit(0)}
    looking = [m for m in methods if m not in ("blind", "uniform")]
    found = []
    if "blind" in methods:
        found.append(items.withColumns({"method": F.lit("blind"), "frames": F.array().cast("array<int>"), **made, "reason": F.lit("no_frames")}))
    if "uniform" in methods:
        spaced = items.join(clips.select("video", F.size("value").alias("n")), "video").withColumn("frames", T.linspace(F.col("n"), 16)).drop("n")
        found.append(spaced.withColumns({"method": F.lit("uniform"), **made, "reason": F.lit("spaced")}))
    if looking:
        found.append(C.choose_packed(items, clips, looking, "qid"))
    return functools.reduce(lambda a, b: a.unionByName(b), found)


def answers_by(items, clips, methods: list[str], judge=J.hash_judge):
    """(qid, truth, lang, type, pred, n_frames, steps, reason, method): frames by each method, then one prompt; no frames where
    some are expected, and no letter in the reply, is -1."""
    got = _chosen(items, clips, methods)
    prompt = F.concat_ws("|", F.lit("Q"), "qid", "source", F.array_join(F.transform("frames", lambda i: i.cast("string")), ","))
    rows = J.ask(got.withColumn("prompt", prompt), judge)
    none = (F.size("frames") == 0) & (F.col("method") != "blind")
    return rows.select("qid", "truth", "lang", "type", F.when(none, -1).otherwise(N.parse_letter(F.col("reply"))).alias("pred"), F.size("frames").alias("n_frames"), "steps", F.when(none & ~F.col("reason").startswith("error"), "no_frames_selected").otherwise(F.col("reason")).alias("reason"), "method")


def answers(items, clips, method: str, judge=J.hash_judge):
    """``answers_by`` of one method, without its name."""
    return answers_by(items, clips, [method], judge).drop("method")


def answered(spark, d, method: str):
    return answers(*_items(spark, d), method)


def resumed(spark, items, clips, method: str, store: str, judge=J.hash_judge):
    """All answers of a method: those kept in ``store`` from earlier runs, and new ones for the items that have none, which are
    committed as a batch. A run that is broken off leaves no part of its batch behind."""
    kept = Checkpoint(spark, store)
    old = kept.read()
    todo = items if old is None else resume.pending(items, old, "qid")
    kept.commit(f"{method}-{len(kept.batches())}", answers(todo, clips, method, judge).withColumn("method", F.lit(method)))
    return kept.read()


def guided_records(spark, d):
    """The records of guided frames: number, time and place in the video, and the shard the video belongs to."""
    clips = _clips(spark, d)
    got = C.choose(clips.withColumn("question", F.col("video")), "guided", "question").select("video", F.explode("frames").alias("idx"))
    n = clips.select("video", F.size("value").alias("n"))
    pos = T.positions(n, "video")
    rows = got.join(pos, "video")
    pct = F.floor((20000 * F.col("idx") + F.col("n") - 1) / (2 * (F.col("n") - 1))).cast("long")
    return rows.select("video", "idx", T.clock(F.col("idx"), 2).alias("time"), F.concat(F.floor(pct / 100).cast("string"), F.lit("."), F.lpad((pct % 100).cast("string"), 2, "0"), F.lit("%")).alias("percent"), (F.col("pos") % 10).alias("shard"))


def _pipeline(method):
    def run(spark, d):
        r = answered(spark, d, method)
        return r.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("truth")).alias("correct"), F.count_if(F.col("pred") == -1).alias("invalid"), F.round(F.avg(F.coalesce("n_frames", F.lit(0))), 6).alias("mean_frames"), F.round(F.avg("steps"), 6).alias("mean_steps"))

    return run


def method_report(spark, d):
    """Accuracy by question type and method: the same driver for all methods, the method a column."""
    items, clips = _items(spark, d)
    rows = answers_by(items, clips, list(C.METHODS))
    kind = F.when(F.col("type") == "TP", "TN").otherwise(F.col("type"))
    ok = (F.col("pred") == F.col("truth")).cast("int")
    g = rows.select("method", kind.alias("type"), F.substring(kind, 1, 1).alias("cat"), ok.alias("ok")).groupingSets([["method", "type"], ["method", "cat"], ["method"]], "method", "type", "cat").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("acc"))
    return g.select("method", F.coalesce(F.concat(F.lit("type:"), "type"), F.concat(F.lit("cat:"), "cat"), F.lit("all")).alias("name"), "n", "acc")


def cached_judge(spark, d):
    """Replies from a cache for half of the prompts, asked for the rest."""
    p = _prompts(spark, d, False)
    cache = p.where("qid % 2 = 0").select(F.sha2("prompt", 256).alias("key"), F.lit("C").alias("reply"))
    return J.cached(p, cache)[0].groupBy("reply").agg(F.count("*").alias("n"))


def frame_jobs(spark, d):
    """Status and timestamps of jobs that cut frames: short videos are skipped, odd ones lack a file."""
    c = X.frames(spark, d).groupBy("video").agg(F.count("*").alias("n"))
    status = F.when(F.col("n") < 60, "SKIP").when(F.col("video") % 7 == 0, "ERROR").otherwise("SUCCESS")
    rows = c.select("video", status.alias("status"), F.when(status == "SUCCESS", F.sequence(F.lit(0), F.lit(4))).otherwise(F.array(F.lit(0))).alias("i"), "n")
    return rows.select("video", "status", F.explode("i").alias("i"), "n").select("video", "status", "i", F.when(F.col("status") == "SUCCESS", F.round(F.col("i") * (F.col("n") - 0.1) / 4, 6)).alias("at_sec"))


def content_range(spark, d):
    """Content bounds by jumps of two seconds over irrelevant frames from either end."""
    return T.jump_bounds(X.frames(spark, d).withColumn("rel", F.col("k") > 30), "video", "idx", "rel", 6)


def replaced_frames(spark, d):
    """New frames, and the relevant ones nearby that take the place of irrelevant ones."""
    f = X.frames(spark, d).withColumn("rel", F.col("k") > 60)
    return T.replaced(f, "video", "idx", "rel", F.col("event_type") == "click", F.col("event_type") == "signup")


QUERIES = {f.__name__: f for f in (force_fill, split_point, adaptive_breadth, kept_frames, judge_batch, cached_judge, frame_jobs, content_range, replaced_frames, method_report, guided_records)}
QUERIES |= {f"tree_search_{s}": _tree(s) for s in S.STRATEGIES} | {f"{m}_search": _search(m) for m in ("capped", "guided", "agent", "cluster")} | {f"superstep_{m}": _steps(m) for m in ("capped", "agent")} | {f"qa_pipeline_{m}": _pipeline(m) for m in C.METHODS}
_F = f"{X.FRAMES}, cnt AS (SELECT video, CAST(count(*) AS INT) AS n FROM frames GROUP BY video)"
SQL = {
    "force_fill": f"""WITH RECURSIVE {_F}, r(video, step, a) AS (SELECT video, 2, [0, n - 1] FROM cnt UNION ALL
      SELECT video, step + 1, list_sort(list_append(a, (SELECT (a[i] + a[i + 1]) // 2 FROM range(1, len(a)) AS t(i) WHERE a[i + 1] - a[i] > 1 ORDER BY a[i + 1] - a[i] DESC, i LIMIT 1))) FROM r
      WHERE step < 8 AND list_max(list_transform(range(1, len(a)), lambda i: a[i + 1] - a[i])) > 1),
      l AS (SELECT video, max(step) AS s FROM r GROUP BY video) SELECT r.video, CAST(unnest(a) AS INT) AS frame FROM r JOIN l ON l.video = r.video AND l.s = r.step""",
    "frame_jobs": f"WITH {_F}, s AS (SELECT video, n, CASE WHEN n < 60 THEN 'SKIP' WHEN video % 7 = 0 THEN 'ERROR' ELSE 'SUCCESS' END AS status FROM cnt) SELECT video, status, CAST(i AS INT) AS i, CASE WHEN status = 'SUCCESS' THEN round(i * (n - 0.1::DOUBLE) / 4, 6) END AS at_sec FROM s, range(5) AS t(i) WHERE status = 'SUCCESS' OR i = 0",
    "content_range": f"""WITH {_F}, f AS (SELECT video, idx, n, k > 30 AS rel FROM frames JOIN cnt USING (video)),
      h AS (SELECT c.video, c.n, coalesce((SELECT min(idx) FROM f WHERE f.video = c.video AND idx % 6 = 0 AND idx <= c.n - 7 AND rel), CASE WHEN c.n - 7 < 0 THEN 0 ELSE ((c.n - 7) // 6 + 1) * 6 END) AS lo FROM cnt c)
      SELECT video, lo, coalesce((SELECT max(idx) FROM f WHERE f.video = h.video AND (h.n - 1 - idx) % 6 = 0 AND idx >= h.lo + 6 AND rel), CASE WHEN h.n - 1 < h.lo + 6 THEN h.n - 1 ELSE h.n - 1 - ((h.n - 1 - h.lo - 6) // 6 + 1) * 6 END) AS hi FROM h""",
    "replaced_frames": f"""WITH {_F}, s AS (SELECT video, idx FROM frames WHERE event_type = 'click'),
      b AS (SELECT f.video, f.idx, f.k > 60 AS rel, coalesce((SELECT max(s.idx) + 1 FROM s WHERE s.video = f.video AND s.idx < f.idx), 0) AS l, coalesce((SELECT min(s.idx) - 1 FROM s WHERE s.video = f.video AND s.idx > f.idx), c.n - 1) AS r FROM frames f JOIN cnt c ON c.video = f.video WHERE f.event_type = 'signup'),
      t AS (SELECT *, greatest(5, (r - l) // 10) AS st FROM b),
      c AS (SELECT t.video, t.idx, 2 * k + CASE WHEN sg = 1 THEN 0 ELSE 1 END AS o, t.idx + sg * k * st AS at FROM t, range(1, 6) AS u(k), (VALUES (1), (-1)) AS v(sg) WHERE NOT rel AND t.idx + sg * k * st BETWEEN l AND r),
      g AS (SELECT c.video, c.idx, arg_min(c.at, c.o) AS at FROM c JOIN frames f ON f.video = c.video AND f.idx = c.at AND f.k > 60 AND f.event_type <> 'click' GROUP BY ALL)
      SELECT t.video, t.idx AS from_idx, CAST(CASE WHEN t.rel THEN t.idx ELSE g.at END AS INT) AS to_idx FROM t LEFT JOIN g ON g.video = t.video AND g.idx = t.idx""",
}
