"""Queries on frames, gaps, samples and segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keyframe.functions import tables
from keyframe.operators import annotations as A
from keyframe.operators import joins as J
from keyframe.operators import timeline as T

from . import surrogates as X

_F = f"WITH {X.FRAMES}"


def _selected(spark, d):
    return X.frames(spark, d).where("event_type = 'click'").select("video", "idx")


_SEL = f"{_F}, sel AS (SELECT video, idx FROM frames WHERE event_type = 'click'), gap AS (SELECT video, idx AS s, lead(idx) OVER (PARTITION BY video ORDER BY idx) AS e FROM sel), gaps AS (SELECT video, s, e, e - s AS g FROM gap WHERE e IS NOT NULL)"


def frontier(spark, d):
    g = T.gaps(_selected(spark, d), "video", "idx")
    return g.select("video", F.row_number().over(Window.partitionBy("video").orderBy("start")).alias("seg_id"), F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), (F.col("gap") > 1).alias("splittable"))


def gap_stats(spark, d):
    return T.coverage(_selected(spark, d), "video", "idx")


def dense_sparse(spark, d):
    g = T.gaps(_selected(spark, d), "video", "idx")
    w = Window.partitionBy("video")
    n, total = F.count("*").over(w), F.sum("gap").over(w)
    return g.withColumn("n", n).withColumn("total", total).select("video", F.col("start").alias("seg_start"), F.when(2 * F.col("gap") * F.col("n") < F.col("total"), "dense").when(2 * F.col("gap") * F.col("n") > 3 * F.col("total"), "sparse").otherwise("even").alias("cover"))


def max_gap_segment(spark, d):
    """The frontier's row for the largest gap, found by both its ends."""
    g = T.gaps(_selected(spark, d), "video", "idx")
    top = g.where("gap > 1").groupBy("video").agg(F.max(F.struct("gap", (-F.col("start")).alias("s"), "end")).alias("m")).select("video", (-F.col("m.s")).alias("start"), F.col("m.end").alias("end"))
    return g.join(top, ["video", "start", "end"]).select("video", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), "gap")


def topk_longest(spark, d):
    g = T.gaps(_selected(spark, d), "video", "idx")
    r = F.row_number().over(Window.partitionBy("video").orderBy(F.desc("gap"), "start"))
    return g.withColumn("place", r).where("place <= 3").select("video", "place", F.col("start").alias("seg_start"), "gap")


def _count(spark, d):
    return X.frames(spark, d).groupBy("video").agg(F.count("*").alias("n"))


_CNT = f"{_F}, cnt AS (SELECT video, count(*) AS n FROM frames GROUP BY video)"


def _sampler(make):
    def run(spark, d):
        return _count(spark, d).select("video", F.posexplode(make(F.col("n"))).alias("pos", "frame"))

    return run


def sample_interval(spark, d):
    """Every tenth frame, and the last."""
    s = _count(spark, d).select("video", "n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1, F.lit(10))).alias("frame"))
    return s.select("video", "frame").union(_count(spark, d).select("video", (F.col("n") - 1).cast("int").alias("frame"))).distinct()


def sample_truncate(spark, d):
    """Selected frames in order, no more than the first 8, then filled from a back-up list to 8."""
    sel = _selected(spark, d).withColumn("src", F.lit(0))
    back = X.frames(spark, d).where("event_type = 'view'").select("video", "idx").withColumn("src", F.lit(1))
    r = F.row_number().over(Window.partitionBy("video").orderBy("src", "idx"))
    return sel.union(back).withColumn("r", r).where("r <= 8").select("video", "idx", "src")


def strided_candidates(spark, d):
    return X.frames(spark, d).where("idx % 4 = 0").groupBy("video").agg(F.slice(F.array_sort(F.collect_list("idx")), 1, 5).alias("c")).select("video", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("candidates"))


def frame_record(spark, d):
    f = X.frames(spark, d)
    n = F.count("*").over(Window.partitionBy("video"))
    f = f.withColumn("n", n)
    pct = F.floor((20000 * F.col("idx") + F.col("n") - 1) / (2 * (F.col("n") - 1))).cast("long")
    return f.select("video", "idx", T.clock(F.col("idx") * 7, 25).alias("time"), F.concat(F.floor(pct / 100).cast("string"), F.lit("."), F.lpad((pct % 100).cast("string"), 2, "0"), F.lit("%")).alias("percent"))


def shards(spark, d):
    """Videos in ten shards by rounded boundaries (half to even); places come from counts by range, not from one sorted task."""
    v = T.positions(X.frames(spark, d).select("video").distinct(), "video")
    n = v.count()
    shard = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda s, k: s + (F.col("pos") >= F.bround(F.lit(n) / 10 * k)).cast("int"))
    return v.select("video", shard.alias("shard"))


def stable_suffix(spark, d):
    f = X.frames(spark, d).withColumn("sim", F.col("k") / 100)
    return T.stable_suffix(f, "video", "idx", "sim", 0.3)


def max_change(spark, d):
    w = Window.partitionBy("video").orderBy("idx")
    f = X.frames(spark, d).withColumn("c", F.abs(F.col("v") - F.lag("v").over(w))).where("c is not null")
    return f.groupBy("video").agg(F.max(F.struct("c", (-F.col("idx")).alias("i"))).alias("m")).select("video", (-F.col("m.i")).alias("idx"), F.col("m.c").alias("change"))


def clearest_near(spark, d):
    """Each signup frame within a segment, or the sharpest frame near it where it is blurred: within a tenth of the segment,
    three frames at least, strictly inside it, and only if sharper; the first of equals."""
    f = X.frames(spark, d).withColumn("sharp", F.col("k") * 2)
    g = T.gaps(_selected(spark, d), "video", "idx").select("video", "start", "end")
    at = f.where("event_type = 'signup'").select("video", F.col("idx").alias("at"), F.col("sharp").alias("own"))
    at = J.points_in_intervals(at, g.where("end > start + 1").withColumn("inner", F.col("start") + 1), "video", "at", "inner").drop("inner")
    reach = F.greatest(F.lit(3), F.floor((F.col("end") - F.col("start")) / 10).cast("int"))
    near = at.where("own < 100").withColumn("idx", F.explode(F.filter(F.sequence(F.col("at") - reach, F.col("at") + reach), lambda i: (i > F.col("start")) & (i < F.col("end")))))
    best = near.join(f.select("video", "idx", "sharp"), ["video", "idx"]).where("sharp > own").groupBy("video", "at").agg(F.max(F.struct("sharp", (-F.col("idx")).alias("i"))).alias("m"))
    return at.join(best, ["video", "at"], "left").select("video", F.col("at").alias("from_idx"), F.coalesce(-F.col("m.i"), F.col("at")).alias("to_idx"))


def _segments(spark, d):
    g = T.gaps(_selected(spark, d), "video", "idx")
    return g.select("video", "start", "end", ((F.col("start") % 3) == 0).alias("chosen"))


def _split(mode):
    def run(spark, d):
        return T.split(_segments(spark, d), "chosen", mode).select("video", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"))

    return run


_SPLIT = f"{_SEL}, h AS (SELECT video, s, e, s % 3 = 0 AS c, (s + e) // 2 AS m FROM gaps)"
_HALVES = "SELECT video, s AS seg_start, m AS seg_end FROM h WHERE c AND e - s > 1 UNION ALL SELECT video, m, e FROM h WHERE c AND e - s > 1 UNION ALL SELECT video, s, e FROM h WHERE c AND e - s <= 1"


def trim_head_tail(spark, d):
    return T.trim(X.frames(spark, d).withColumn("rel", F.col("k") > 60), "video", "idx", "rel")


def range_frames(spark, d):
    """Number and sum of the frames of each video within a segment [start, end)."""
    g = T.gaps(_selected(spark, d), "video", "idx").select("video", "start", "end")
    j = J.points_in_intervals(X.frames(spark, d).select("video", "idx", "v"), g, "video", "idx")
    return j.groupBy("video", F.col("start").alias("seg_start")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def nearest_frame(spark, d):
    """For each error frame the nearest clicked one, first of equals; videos without clicks have none."""
    asked = X.frames(spark, d).where("event_type = 'error'").select("video", F.col("idx").alias("from_idx"))
    return J.nearest(asked, _selected(spark, d).withColumnRenamed("idx", "to_idx"), "video", "from_idx", "to_idx").where("to_idx is not null")


def bounded_range(spark, d):
    """Sampled frames within content bounds; the bounds where none is."""
    b = T.trim(X.frames(spark, d).withColumn("rel", F.col("k") > 90), "video", "idx", "rel").join(_count(spark, d), "video")
    kept = F.filter(F.sequence(F.lit(0), F.col("n").cast("int") - 1, F.lit(15)), lambda i: i.between(F.col("lo"), F.col("hi")))
    return b.select("video", F.explode(F.when(F.size(kept) == 0, F.array("lo", "hi")).otherwise(kept)).alias("frame"))


def _annotating(spark, d):
    """Events as those of annotation sessions: clicks choose an action, signups give a direction, views a box, errors undo, and
    purchases delete one of the first four."""
    k = F.col("k")
    actions = F.array(*map(F.lit, ("CLICK", "SCROLL", "TYPE", "DRAG", "FINISH", "HOTKEY")))
    return X.frames(spark, d).select(
        "video", "idx",
        F.element_at(F.create_map(*(F.lit(x) for pair in (("click", "select"), ("signup", "direction"), ("view", "box"), ("error", "undo"), ("purchase", "delete")) for x in pair)), F.col("event_type")).alias("op"),
        F.col("idx").cast("long").alias("frame"), F.element_at(actions, k % 6 + 1).alias("action"), F.when(k % 4 > 0, F.concat(F.lit(" Key"), k.cast("string"))).alias("text"),
        F.when(k % 3 > 0, F.element_at(F.array(F.lit("up"), F.lit("down")), k % 3)).alias("direction"), k.alias("width"), F.lit(4).alias("height"), (k % 4).alias("place"),
    )


def annotation_replay(spark, d):
    """The annotations that stand at the end of each session."""
    return A.replay(_annotating(spark, d), "video", "idx")


def lateral_samples(spark, d):
    """Four ways to sample, in SQL text by a table function."""
    tables.register(spark)
    return spark.sql("SELECT v.video, w.how, s.pos, s.frame FROM {videos} v, (SELECT explode(map('linspace', 16, 'rounded', 10, 'stride', 7, 'interval', 10)) AS (how, k)) w, LATERAL sample_frames(CAST(v.n AS INT), w.k, w.how) s", videos=_count(spark, d))


def lateral_segments(spark, d):
    """Segments of the selected frames, and what is left of them after a split in each of three ways, by table functions."""
    tables.register(spark)
    at = _selected(spark, d).groupBy("video").agg(F.array_sort(F.collect_list("idx")).alias("frames"), F.collect_list(F.when(F.col("idx") % 3 == 0, F.col("idx"))).alias("chosen"))
    return spark.sql("SELECT v.video, 'frontier' AS how, s.seg_start, s.seg_end FROM {at} v, LATERAL frontier_segments(v.frames, 2) s UNION ALL SELECT v.video, w.how, s.seg_start, s.seg_end FROM {at} v, (SELECT explode(array('retain', 'prune', 'merge')) AS how) w, LATERAL split_segments(v.frames, v.chosen, w.how) s", at=at)


def neighbour_bounds(spark, d):
    w = Window.partitionBy("video").orderBy("idx")
    return _selected(spark, d).select("video", "idx", F.lag("idx").over(w).alias("left_idx"), F.lead("idx").over(w).alias("right_idx"))


QUERIES = {f.__name__: f for f in (frontier, gap_stats, dense_sparse, max_gap_segment, topk_longest, sample_interval, sample_truncate, strided_candidates, frame_record, shards, stable_suffix, max_change, clearest_near, trim_head_tail, range_frames, nearest_frame, bounded_range, neighbour_bounds, annotation_replay, lateral_samples, lateral_segments)}
QUERIES |= {f"split_{m}": _split(m) for m in ("prune", "retain", "merge")} | {"sample_linspace": _sampler(lambda n: T.linspace(n, 16)), "sample_rounded": _sampler(lambda n: T.rounded(n, 10)), "sample_stride": _sampler(lambda n: T.stride(n, 7))}


def _sampled(k, value):
    return f"{_CNT} SELECT video, CAST(i AS INT) AS pos, CAST({value} AS INT) AS frame FROM cnt, unnest(range({k})) AS u(i)"


SQL = {
    "frontier": f"{_SEL} SELECT video, CAST(row_number() OVER (PARTITION BY video ORDER BY s) AS INT) AS seg_id, s AS seg_start, e AS seg_end, g > 1 AS splittable FROM gaps",
    "gap_stats": f"""{_SEL}, t AS (SELECT video, count(*) AS n, sum(g) AS t FROM gaps GROUP BY video), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY g DESC, s) AS r FROM gaps) WHERE r = 1)
      SELECT t.video, t.n, round(t.t / t.n, 6) AS avg_gap, m.g AS max_gap, m.s AS max_start, m.e AS max_end, m.g * t.n > 3 * t.t AS imbalanced, CAST((SELECT count(*) FROM gaps x WHERE x.video = t.video AND x.g * t.n > 2 * t.t) AS INT) AS n_sparse FROM t JOIN m ON m.video = t.video""",
    "dense_sparse": f"{_SEL}, a AS (SELECT *, avg(g) OVER (PARTITION BY video) AS m FROM gaps) SELECT video, s AS seg_start, CASE WHEN g < 0.5 * m THEN 'dense' WHEN g > 1.5 * m THEN 'sparse' ELSE 'even' END AS cover FROM a",
    "max_gap_segment": f"{_SEL} SELECT video, s AS seg_start, e AS seg_end, g AS gap FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY g DESC, s) AS r FROM gaps WHERE g > 1) WHERE r = 1",
    "topk_longest": f"{_SEL} SELECT video, CAST(r AS INT) AS place, s AS seg_start, g AS gap FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY g DESC, s) AS r FROM gaps) WHERE r <= 3",
    "sample_linspace": _sampled(16, "i * (n - 1) // 15"), "sample_rounded": _sampled(10, "round_even(i * (n - 1) / 9, 0)"), "sample_stride": _sampled(7, "i * n // 7"),
    "sample_interval": f"{_CNT} SELECT video, idx AS frame FROM frames JOIN cnt USING (video) WHERE idx % 10 = 0 OR idx = n - 1",
    "sample_truncate": f"{_F} SELECT video, idx, CAST(src AS INT) AS src FROM (SELECT video, idx, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS src, row_number() OVER (PARTITION BY video ORDER BY event_type = 'view', idx) AS r FROM frames WHERE event_type IN ('click', 'view')) WHERE r <= 8",
    "strided_candidates": f"{_F} SELECT video, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS candidates FROM frames WHERE idx % 4 = 0 AND idx < 20 GROUP BY video",
    "frame_record": f"""{_CNT} SELECT video, idx, lpad(CAST(idx * 7 // 25 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(idx * 7 // 25 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(idx * 7 % 25 AS VARCHAR), 2, '0') AS time,
      CAST((20000 * idx + n - 1) // (2 * (n - 1)) // 100 AS VARCHAR) || '.' || lpad(CAST((20000 * idx + n - 1) // (2 * (n - 1)) % 100 AS VARCHAR), 2, '0') || '%' AS percent FROM frames JOIN cnt USING (video)""",
    "shards": f"{_F}, v AS (SELECT video, row_number() OVER (ORDER BY video) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT video FROM frames)) SELECT video, CAST((SELECT count(*) FROM range(1, 10) AS t(k) WHERE pos >= round_even(n / 10 * k, 0)) AS INT) AS shard FROM v",
    "stable_suffix": f"{_F}, m AS (SELECT video, idx, k / 100 >= 0.3 AS ok FROM frames), l AS (SELECT video, max(idx) FILTER (NOT ok) AS b, max(idx) AS e FROM m GROUP BY video) SELECT video, CAST(coalesce(b + 1, 0) AS INT) AS stable_from FROM l WHERE b IS NULL OR b < e",
    "max_change": f"{_F}, c AS (SELECT video, idx, abs(v - lag(v) OVER (PARTITION BY video ORDER BY idx)) AS c FROM frames) SELECT video, idx, c AS change FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY c DESC, idx) AS r FROM c WHERE c IS NOT NULL) WHERE r = 1",
    "clearest_near": f"""{_SEL}, t AS (SELECT f.video, f.idx AS a, f.k * 2 AS own, g.s, g.e FROM frames f JOIN gaps g ON g.video = f.video AND f.idx > g.s AND f.idx < g.e WHERE f.event_type = 'signup'),
      c AS (SELECT t.video, t.a, f.idx AS i, f.k * 2 AS sh FROM t JOIN frames f ON f.video = t.video AND f.idx BETWEEN t.a - greatest(3, (t.e - t.s) // 10) AND t.a + greatest(3, (t.e - t.s) // 10) AND f.idx > t.s AND f.idx < t.e AND f.k * 2 > t.own WHERE t.own < 100),
      b AS (SELECT video, a, i FROM (SELECT *, row_number() OVER (PARTITION BY video, a ORDER BY sh DESC, i) AS r FROM c) WHERE r = 1) SELECT t.video, t.a AS from_idx, coalesce(b.i, t.a) AS to_idx FROM t LEFT JOIN b ON b.video = t.video AND b.a = t.a""",
    "split_prune": f"{_SPLIT} {_HALVES}",
    "split_retain": f"{_SPLIT} {_HALVES} UNION ALL SELECT video, s, e FROM h WHERE NOT c",
    "split_merge": f"{_SPLIT}, z AS (SELECT *, sum(CAST(c AS INT)) OVER (PARTITION BY video ORDER BY s) AS z FROM h) {_HALVES} UNION ALL SELECT video, min(s), max(e) FROM z WHERE NOT c GROUP BY video, z",
    "trim_head_tail": f"{_F} SELECT video, coalesce(min(idx) FILTER (k > 60), min(idx)) AS lo, coalesce(max(idx) FILTER (k > 60), max(idx)) AS hi FROM frames GROUP BY video",
    "range_frames": f"{_SEL} SELECT g.video, g.s AS seg_start, count(*) AS n, CAST(sum(f.v) AS BIGINT) AS total FROM gaps g JOIN frames f ON f.video = g.video AND f.idx >= g.s AND f.idx < g.e GROUP BY ALL",
    "nearest_frame": f"{_SEL} SELECT video, from_idx, to_idx FROM (SELECT a.video, a.idx AS from_idx, b.idx AS to_idx, row_number() OVER (PARTITION BY a.video, a.idx ORDER BY abs(a.idx - b.idx), b.idx) AS r FROM frames a JOIN sel b ON a.video = b.video WHERE a.event_type = 'error') WHERE r = 1",
    "bounded_range": f"{_CNT}, t AS (SELECT video, coalesce(min(idx) FILTER (k > 90), min(idx)) AS lo, coalesce(max(idx) FILTER (k > 90), max(idx)) AS hi FROM frames GROUP BY video), s AS (SELECT f.video, f.idx AS frame FROM frames f JOIN t USING (video) WHERE f.idx % 15 = 0 AND f.idx BETWEEN lo AND hi) SELECT * FROM s UNION ALL SELECT video, unnest([lo, hi]) FROM t WHERE video NOT IN (SELECT video FROM s)",
    "annotation_replay": f"""WITH RECURSIVE {X.FRAMES}, e AS (SELECT video, idx, event_type AS op, (['CLICK', 'SCROLL', 'TYPE', 'DRAG', 'FINISH', 'HOTKEY'])[k % 6 + 1] AS action, CASE WHEN k % 4 > 0 THEN ' Key' || k END AS txt, CASE k % 3 WHEN 1 THEN 'up' WHEN 2 THEN 'down' END AS dir, k, k % 4 AS place FROM frames),
      f AS (SELECT *, CASE action WHEN 'HOTKEY' THEN lower(trim(txt)) WHEN 'TYPE' THEN txt END AS said, op = 'click' AND (action = 'FINISH' OR action IN ('TYPE', 'HOTKEY') AND txt IS NOT NULL) AS at_once FROM e),
      w AS (SELECT DISTINCT video, CAST(0 AS INT) AS idx, '' AS needs, {{'frame': CAST(NULL AS BIGINT), 'action': CAST(NULL AS VARCHAR), 'text': CAST(NULL AS VARCHAR), 'direction': CAST(NULL AS VARCHAR)}} AS p,
          CAST([] AS STRUCT(frame BIGINT, action VARCHAR, text VARCHAR, direction VARCHAR)[]) AS notes, CAST([] AS BIGINT[]) AS undo FROM frames
        UNION ALL SELECT f.video, f.idx + 1,
          CASE WHEN op = 'click' THEN CASE WHEN action IN ('TYPE', 'HOTKEY', 'FINISH') THEN '' WHEN action = 'SCROLL' THEN 'direction' ELSE 'box' END WHEN op = 'signup' AND needs = 'direction' AND dir IS NOT NULL THEN 'box'
            WHEN op = 'view' AND needs IN ('box', 'second') AND k >= 5 THEN CASE WHEN needs = 'box' AND p.action = 'DRAG' THEN 'second' ELSE '' END ELSE needs END,
          CASE WHEN op = 'click' THEN {{'frame': CAST(f.idx AS BIGINT), 'action': f.action, 'text': CAST(NULL AS VARCHAR), 'direction': CAST(NULL AS VARCHAR)}} WHEN op = 'signup' AND needs = 'direction' AND dir IS NOT NULL THEN {{'frame': p.frame, 'action': p.action, 'text': p.text, 'direction': dir}} ELSE p END,
          CASE WHEN at_once THEN list_append(notes, {{'frame': CAST(f.idx AS BIGINT), 'action': f.action, 'text': said, 'direction': CAST(NULL AS VARCHAR)}}) WHEN op = 'view' AND k >= 5 AND (needs = 'second' OR needs = 'box' AND p.action <> 'DRAG') THEN list_append(notes, p)
            WHEN op = 'error' AND len(undo) > 0 THEN list_filter(notes, lambda x, i: i <> undo[-1] + 1) WHEN op = 'purchase' THEN list_filter(notes, lambda x, i: i <> place + 1) ELSE notes END,
          CASE WHEN at_once OR op = 'view' AND k >= 5 AND (needs = 'second' OR needs = 'box' AND p.action <> 'DRAG') THEN list_append(undo, len(notes)) WHEN op = 'error' THEN undo[:-2] ELSE undo END
        FROM w JOIN f ON f.video = w.video AND f.idx = w.idx),
      z AS (SELECT video, notes FROM w WHERE idx = (SELECT count(*) FROM frames x WHERE x.video = w.video))
      SELECT video, CAST(i AS INT) AS pos, notes[i + 1].frame AS frame, notes[i + 1].action AS action, notes[i + 1].text AS text, notes[i + 1].direction AS direction FROM z, unnest(range(len(notes))) AS u(i)""",
    "neighbour_bounds": f"{_SEL} SELECT video, idx, lag(idx) OVER w AS left_idx, lead(idx) OVER w AS right_idx FROM sel WINDOW w AS (PARTITION BY video ORDER BY idx)",
}
SQL["lateral_samples"] = f"""{_CNT} SELECT video, how, CAST(i AS INT) AS pos, CAST(CASE how WHEN 'linspace' THEN i * (n - 1) // 15 WHEN 'rounded' THEN round_even(i * (n - 1) / 9, 0) ELSE i * n // 7 END AS INT) AS frame
  FROM cnt, (VALUES ('linspace', 16), ('rounded', 10), ('stride', 7)) AS w(how, k), range(16) AS u(i) WHERE i < k
  UNION ALL SELECT video, 'interval', CAST(row_number() OVER (PARTITION BY video ORDER BY idx) - 1 AS INT), idx FROM frames JOIN cnt USING (video) WHERE idx % 10 = 0 OR idx = n - 1"""
SQL["lateral_segments"] = f"{_SPLIT}, z AS (SELECT *, sum(CAST(c AS INT)) OVER (PARTITION BY video ORDER BY s) AS z FROM h), halves AS ({_HALVES}) SELECT video, 'frontier' AS how, s AS seg_start, e AS seg_end FROM gaps WHERE e - s > 1 UNION ALL SELECT video, how, seg_start, seg_end FROM halves, (VALUES ('retain'), ('prune'), ('merge')) AS w(how) UNION ALL SELECT video, 'retain', s, e FROM h WHERE NOT c UNION ALL SELECT video, 'merge', min(s), max(e) FROM z WHERE NOT c GROUP BY video, z"
