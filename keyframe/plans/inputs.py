"""Queries on inputs: narrated items, reference images, prompts' rows, replies and formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keyframe.functions import actions as A
from keyframe.functions import answers as N
from keyframe.operators import pictures as P
from keyframe.operators import timeline as T
from keyframe.sources import readers as R

from . import surrogates as X

_Q, _F = f"WITH {X.QA}", f"WITH {X.FRAMES}"


def _log(q):
    """An evaluation log of a question's numbers; every second one lacks the type accuracy, every third the table."""
    n = F.col("n_chars")
    share = F.concat(F.lit("0."), F.lpad((n % 10000).cast("string"), 4, "0"))
    row = F.concat(F.lit("\nCLICK        | "), F.rpad((n % 900).cast("string"), 6, " "), F.lit(" | "), F.rpad(share, 15, " "), F.lit(" | 0.5000      \nSCROLL       | 12     | 0.2500          | 0.7500      "))
    return F.concat(F.lit("run\nTotal Steps          | "), F.rpad(n.cast("string"), 10, " "), F.lit("\nOverall Score        | 0.9999    "), F.when(F.col("qid") % 2 == 0, F.concat(F.lit("\nOverall Type Acc     | "), F.rpad(share, 10, " "))).otherwise(""), F.when(F.col("qid") % 3 > 0, row).otherwise(""), F.lit("\n[Overall Avg Score]: "), share, F.lit("\n  Avg Episode Completion : 0.5000 (7 episodes)\n  Avg Images Per Step    : "), (n % 11).cast("string"), F.lit(".00 (9 steps)"))


def log_metrics(spark, d):
    q = X.qa(spark, d)
    return q.select("qid", *R.log_metrics(_log(q)))


_LOG = f"""{_Q}, l0 AS (SELECT qid, n_chars AS n, '0.' || lpad(CAST(n_chars % 10000 AS VARCHAR), 4, '0') AS s FROM qa),
  l1 AS (SELECT qid, 'run' || chr(10) || 'Total Steps          | ' || rpad(CAST(n AS VARCHAR), 10, ' ') || chr(10) || 'Overall Score        | 0.9999    ' || CASE WHEN qid % 2 = 0 THEN chr(10) || 'Overall Type Acc     | ' || rpad(s, 10, ' ') ELSE '' END
    || CASE WHEN qid % 3 > 0 THEN chr(10) || 'CLICK        | ' || rpad(CAST(n % 900 AS VARCHAR), 6, ' ') || ' | ' || rpad(s, 15, ' ') || ' | 0.5000      ' || chr(10) || 'SCROLL       | 12     | 0.2500          | 0.7500      ' ELSE '' END
    || chr(10) || '[Overall Avg Score]: ' || s || chr(10) || '  Avg Episode Completion : 0.5000 (7 episodes)' || chr(10) || '  Avg Images Per Step    : ' || (n % 11) || '.00 (9 steps)' AS t FROM l0)"""
_NUM = "TRY_CAST(regexp_extract(t, '{0}', {1}) AS {2})"
_LOG_COLS = [_NUM.format(p, 1, k) + f" AS {c}" for c, p, k in (("acc", R.OVERALL_SCORE, "DOUBLE"), ("type_acc", R.OVERALL_TYPE_ACC, "DOUBLE"), ("completion", R.EPISODE_COMPLETION, "DOUBLE"), ("images", R.IMAGES_PER_STEP, "DOUBLE"), ("total_steps", R.TOTAL_STEPS, "INT"))]
_LOG_COLS += [_NUM.format(rf"{c}\s*\|\s*(\d+)\s*\|\s*([\d.]+)\s*\|\s*([\d.]+)", i, k) + f" AS {c.lower()}_{n}" for c in R.CLASSES for i, n, k in ((1, "count", "INT"), (2, "score", "DOUBLE"), (3, "type_acc", "DOUBLE"))]


def run_folders(spark, d):
    """Model and mode of runs' folders; a folder of neither mode has none."""
    p = X.table(spark, d, "part").select("p_partkey", F.concat(F.lit("/logs/"), F.lower("p_brand"), F.element_at(F.array(F.lit("_single"), F.lit("_uniform10"), F.lit("_other")), (F.col("p_size") % 3 + 1).cast("int")), F.lit("/run.log")).alias("path"))
    return p.select("p_partkey", *R.run_folder(F.col("path")))


def _narrations(spark, d):
    c = X.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("a"))
    return c.select(F.col("conv_id").cast("long").alias("video_id"), F.transform("a", lambda x: x["role"]).alias("a"))


def caption_items(spark, d):
    """Questions with the narration and duration of their video; those of videos without narration are left out."""
    q = X.qa(spark, d).select("qid", (F.col("qid") % 997).alias("video_id"), "truth")
    n = _narrations(spark, d)
    return R.narrated(q, n.select("video_id", R.narration(F.col("a")).alias("narration")), n.select("video_id", (F.size("a") * 30).alias("duration"))).select("qid", "truth", "narration", "duration")


def narration_lines(spark, d):
    """Every second caption, a line each, with its index in front."""
    return _narrations(spark, d).select("video_id", R.narration(F.col("a"), 2).alias("narration"))


_NARR = "WITH n0 AS (SELECT CAST(conv_id AS BIGINT) AS video_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS r FROM conversations)"


def reference_images(spark, d):
    """Reference folder and images of a step by mode, its own screen last: frames of a video stand for a folder's images."""
    modes = ["single", "gt", "annotation", "origin", "uniform10"]
    f = X.frames(spark, d)
    name = F.concat(F.lit("f"), F.lpad(F.col("idx").cast("string"), 4, "0"), F.lit(".png"))
    v = f.groupBy("video").agg(F.collect_list(name).alias("files"))
    mode = F.element_at(F.array(*map(F.lit, modes)), (F.col("video") % 5 + 1).cast("int"))
    v = v.withColumn("mode", mode).withColumn("own", F.when(F.col("video") % 2 == 0, F.lit("own_annot.png")))
    images = R.call_images(R.reference_images(F.col("mode"), F.col("files"), F.col("own")), F.lit("screen.png"))
    return v.select("video", R.reference_folder(F.col("mode"), F.col("video") % 3 == 0).alias("folder"), F.size(images).alias("n"), F.array_join(images, ",").alias("images"))


def segment_rows(spark, d):
    """A line for each segment that can be split: its number, frames, the numbers of its images, and its gap."""
    g = T.gaps(X.frames(spark, d).where("event_type = 'click'").select("video", "idx"), "video", "idx")
    i = F.row_number().over(Window.partitionBy("video").orderBy("start"))
    line = F.format_string("%d) from frame %d to frame %d, between pictures %d and %d: %d frames apart", "seg_id", "start", "end", "seg_id", F.col("seg_id") + 1, "gap")
    return g.withColumn("seg_id", i).where("gap > 1").select("video", "seg_id", line.alias("line"))


def json_replies(spark, d):
    """What is read out of replies in several forms: fenced, bare, a list, single quotes, upper-case keys, nothing."""
    q = X.qa(spark, d)
    n = F.col("n_chars").cast("string")
    forms = [F.concat(F.lit("ok\n```json\n{\"Segment_ID\": \""), n, F.lit("-9\"}\n```")), F.concat(F.lit("{\"segment_id\": "), n, F.lit("}")), F.concat(F.lit("[{\"SEGMENT_ID\": \"no "), n, F.lit("\"}]")), F.concat(F.lit("I take {'segment_id': '"), n, F.lit("'} now")), F.lit("none")]
    reply = F.element_at(F.array(*forms), (F.col("qid") % 5 + 1).cast("int"))
    return q.select("qid", N.segment_id(N.field_any_case(N.unwrapped(N.json_text(reply)), "segment_id")).alias("segment"))


def answer_pairs(spark, d):
    q = X.qa(spark, d)
    n, m = (F.col("n_chars") % 8).cast("string"), (F.col("qid") % 4).cast("string")
    forms = [F.concat(F.lit('{"ANSWER": '), n, F.lit(', "CONFIDENCE": '), m, F.lit("}")), F.concat(F.lit('{"ANSWER": "option '), n, F.lit('", "CONFIDENCE": "about '), m, F.lit('"}')), F.concat(F.lit('{"ANSWER": "'), n, F.lit('"}')), F.concat(F.lit('{"ANSWER": "x", "CONFIDENCE": "'), m, F.lit('"}'))]
    reply = F.element_at(F.array(*forms), (F.col("qid") % 4 + 1).cast("int"))
    return q.select("qid", N.answer_pair(reply).alias("p")).select("qid", "p.answer", "p.confidence")


def clock_formats(spark, d):
    f = X.frames(spark, d)
    return f.select("video", "idx", N.hms(F.col("idx") * 37.25).alias("hms"), N.minutes(F.col("idx") * 37, F.lit(5)).alias("m_ss"))


def run_times(spark, d):
    """Time stamps in two forms, and what has gone by since; an unknown form counts as none."""
    q = X.qa(spark, d)
    mi, se = F.lpad((F.col("n_chars") % 60).cast("string"), 2, "0"), F.lpad((F.col("qid") % 60).cast("string"), 2, "0")
    text = F.when(F.col("qid") % 3 == 0, F.concat(F.lit("2024030411"), mi, se)).when(F.col("qid") % 3 == 1, F.concat(F.lit("2024_03_04-10_"), mi, F.lit("_"), se)).otherwise("yesterday")
    at = N.run_time(text)
    return q.select("qid", F.date_format(at, "HH:mm:ss").alias("at"), N.elapsed(at, F.to_timestamp(F.lit("2024-03-04 12:30:00"))).alias("gone"))


def canvas_boxes(spark, d):
    """Corners on a canvas as shares of the picture, and as a box in pixels."""
    p = X.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 7 % 120).cast("double").alias("x"), (F.col("p_partkey") % 90).cast("double").alias("y"))
    unit = lambda c, size: N.to_unit(c, F.lit(10.0), F.lit(size), F.lit(0.5))
    box = N.box_of_corners(unit(F.col("x"), 160.0), unit(F.col("y"), 120.0), unit(F.col("x") - 16, 160.0), unit(F.col("y") + 12, 120.0))
    p = p.select("p_partkey", "x", box.alias("b"))
    one = F.array(F.struct(F.col("b")[1].alias("y"), F.col("b")[0].alias("x"), F.col("b")[3].alias("h"), F.col("b")[2].alias("w")))
    px = N.pixel_boxes(one, F.lit(320), F.lit(240))[0]
    return p.select("p_partkey", *(F.round(F.col("b")[i], 6).alias(c) for i, c in enumerate(("bx", "by", "bw", "bh"))), px["left"].alias("left_px"), px["top"].alias("top_px"), px["right"].alias("right_px"), px["bottom"].alias("bottom_px"), F.round(N.to_canvas(F.col("b")[0], F.lit(10.0), F.lit(160.0), F.lit(0.5)), 6).alias("back_x"))


def predicted_format(spark, d):
    """Predicted actions as dual points (y, x): taps at their point, the four scrolls as fixed strokes, others at (-1, -1)."""
    s = X.steps(spark, d)
    kind = F.element_at(F.array(*map(F.lit, (4, 0, 1, 8, 9, 3, 5))), (F.col("pk") % 7 + 1).cast("int"))
    p = A.predicted_points(kind, F.col("xi") / 100, F.col("yi") / 100, F.col("type_text"))
    return s.select("ep", "step", p.alias("p")).select("ep", "step", "p.*")


def chosen_ids(spark, d):
    """Ids to work on, where a later rule overrides those before it: the first 300, then those answered wrong in a log, without
    one id; a list of ids, if there is one, overrides all."""
    q = X.qa(spark, d)
    base = q.orderBy("qid").limit(300)
    log = q.where("qid % 2 = 0 and pred <> truth")
    return T.overriding(base.select("qid"), rerun=log.select("qid"), avoid=[8], listed=None, key="qid")


def sampled_captions(spark, d):
    """Captions at every third place from 1, each with its frame's name."""
    v = _narrations(spark, d)
    at = F.filter(F.sequence(F.lit(1), F.size("a")), lambda i: i % 3 == 1)
    return v.select("video_id", F.explode(at).alias("idx"), "a").select("video_id", F.concat(F.lit("frame "), F.col("idx").cast("string")).alias("frame"), F.element_at("a", F.col("idx")).alias("caption"))


def first_non_empty(spark, d):
    """The first error or signup of each video that has one, by time."""
    some = F.col("event_type").isin("error", "signup")
    return X.frames(spark, d).groupBy("video").agg(F.min(F.when(some, F.struct("idx", "event_type"))).alias("m")).where("m is not null").select("video", F.col("m.event_type").alias("kind"))


def selected_segments(spark, d):
    """Segments that are among those chosen elsewhere, by both their ends."""
    f = X.frames(spark, d).where("event_type = 'click'").select("video", "idx")
    g = T.gaps(f, "video", "idx")
    chosen = T.gaps(X.frames(spark, d).where("event_type = 'click' and (k < 50 or idx % 2 = 0)").select("video", "idx"), "video", "idx")
    return g.join(chosen, ["video", "start", "end"], "left_semi").select("video", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"))


def schema_union(spark, d):
    """Metric rows of two runs with unlike metrics: the union of their columns."""
    q = X.qa(spark, d)
    a = q.where("qid % 2 = 0").select("qid", F.col("n_chars").alias("steps"))
    b = q.where("qid % 2 = 1").select("qid", F.col("pred").alias("forced"))
    return a.unionByName(b, allowMissingColumns=True)


def scene_jobs(spark, d):
    """Scenes of recordings with their boxes; recordings that aren't local are marked."""
    f = X.frames(spark, d).where("event_type = 'error'").groupBy("video").agg(F.array_sort(F.collect_list("idx")).alias("at"))
    videos = f.select(F.col("video").alias("video_id"), F.transform("at", lambda i: i * 0.5).alias("at"), F.transform(F.slice("at", 1, 3), lambda i: i * 10).alias("boxes"))
    local = f.where("video % 3 > 0").select(F.col("video").alias("video_id"))
    return P.scene_jobs(videos, local).select("video_id", "ok", "i", "at_sec", "box")


def tags(spark, d):
    p = X.table(spark, d, "part")
    return p.select("p_partkey", R.tag(F.concat(F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit(":1"))).alias("tag"))


QUERIES = {f.__name__: f for f in (log_metrics, run_folders, caption_items, narration_lines, reference_images, segment_rows, json_replies, answer_pairs, clock_formats, run_times, canvas_boxes, predicted_format, chosen_ids, sampled_captions, first_non_empty, selected_segments, schema_union, scene_jobs, tags)}
SQL = {
    "log_metrics": f"{_LOG} SELECT qid, {', '.join(_LOG_COLS)} FROM l1",
    "run_folders": "WITH p AS (SELECT p_partkey, lower(p_brand) || (['_single', '_uniform10', '_other'])[CAST(p_size % 3 + 1 AS INT)] AS f FROM part) SELECT p_partkey, CASE WHEN f LIKE '%\\_single' ESCAPE '\\' THEN left(f, length(f) - 7) WHEN f LIKE '%\\_uniform10' ESCAPE '\\' THEN left(f, length(f) - 10) END AS model, CASE WHEN f LIKE '%\\_single' ESCAPE '\\' THEN 'single' WHEN f LIKE '%\\_uniform10' ESCAPE '\\' THEN 'uniform10' END AS mode FROM p",
    "caption_items": f"{_NARR}, {X.QA}, n AS (SELECT video_id, string_agg(role, '. ' ORDER BY r) AS narration, CAST(count(*) * 30 AS INT) AS duration FROM n0 GROUP BY video_id) SELECT qid, truth, narration, duration FROM qa JOIN n ON n.video_id = qid % 997",
    "narration_lines": f"{_NARR} SELECT video_id, coalesce(string_agg(r || ': ' || role, '.' || chr(10) ORDER BY r) FILTER (r % 2 = 0), '') AS narration FROM n0 GROUP BY video_id",
    "reference_images": f"""{_F}, v AS (SELECT video, list('f' || lpad(CAST(idx AS VARCHAR), 4, '0') || '.png' ORDER BY idx) AS a, count(*) AS n, (['single', 'gt', 'annotation', 'origin', 'uniform10'])[CAST(video % 5 + 1 AS INT)] AS m FROM frames GROUP BY video),
      r AS (SELECT *, CASE WHEN m = 'single' OR (m = 'gt' AND video % 2 > 0) THEN [] WHEN m = 'gt' THEN ['own_annot.png'] WHEN m = 'annotation' AND n > 10 THEN list_transform(range(10), lambda i: a[CAST(round_even(i * (n - 1) / 9, 0) + 1 AS INT)]) ELSE a END AS refs FROM v),
      w AS (SELECT *, list_append(refs, 'screen.png') AS al FROM r)
      SELECT video, CASE m WHEN 'single' THEN NULL WHEN 'gt' THEN 'annotation' WHEN 'uniform10' THEN 'uniform_10' ELSE m END || CASE WHEN video % 3 = 0 THEN '_no_cut' ELSE '' END AS folder, CAST(len(al) AS INT) AS n, array_to_string(al, ',') AS images FROM w""",
    "segment_rows": f"{_F}, s AS (SELECT video, idx, lead(idx) OVER (PARTITION BY video ORDER BY idx) AS e, CAST(row_number() OVER (PARTITION BY video ORDER BY idx) AS INT) AS i FROM frames WHERE event_type = 'click') SELECT video, i AS seg_id, printf('%d) from frame %d to frame %d, between pictures %d and %d: %d frames apart', i, idx, e, i, i + 1, e - idx) AS line FROM s WHERE e - idx > 1",
    "json_replies": f"{_Q} SELECT qid, CASE WHEN qid % 5 < 4 THEN CAST(n_chars AS INT) END AS segment FROM qa",
    "answer_pairs": f"{_Q}, t AS (SELECT qid, CAST(n_chars % 8 AS INT) AS n, CAST(qid % 4 AS INT) AS m FROM qa) SELECT qid, CASE m WHEN 0 THEN CASE WHEN n <= 4 THEN n ELSE -1 END WHEN 1 THEN n WHEN 2 THEN n ELSE -1 END AS answer, CASE m WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS confidence FROM t",
    "clock_formats": f"{_F}, t AS (SELECT video, idx, idx * 37250 AS ms, idx * 37 // 5 AS s FROM frames) SELECT video, idx, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS hms, printf('%d:%02d', s // 60, s % 60) AS m_ss FROM t",
    "run_times": f"""{_Q}, t AS (SELECT qid, CASE WHEN qid % 3 < 2 THEN CASE WHEN qid % 3 = 0 THEN 11 ELSE 10 END * 3600 + n_chars % 60 * 60 + qid % 60 END AS s FROM qa)
      SELECT qid, CASE WHEN s IS NOT NULL THEN printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) END AS at, printf('%d:%02d:%02d', coalesce(45000 - s, 0) // 3600, coalesce(45000 - s, 0) // 60 % 60, coalesce(45000 - s, 0) % 60) AS gone FROM t""",
    "canvas_boxes": """WITH p AS (SELECT p_partkey, CAST(p_size * 7 % 120 AS DOUBLE) AS x, CAST(p_partkey % 90 AS DOUBLE) AS y FROM part),
      u AS (SELECT p_partkey, greatest(0, least(1, (x - 10) / 80)) AS x0, greatest(0, least(1, (y - 10) / 60)) AS y0, greatest(0, least(1, (x - 26) / 80)) AS x1, greatest(0, least(1, (y + 2) / 60)) AS y1 FROM p),
      b AS (SELECT p_partkey, least(x0, x1) AS bx, least(y0, y1) AS by_, abs(x1 - x0) AS bw, abs(y1 - y0) AS bh FROM u),
      q AS (SELECT *, CAST(greatest(0, least(319, floor(bx * 320))) AS INT) AS l, CAST(greatest(0, least(239, floor(by_ * 240))) AS INT) AS t, CAST(greatest(0, least(319, ceil((bx + bw) * 320))) AS INT) AS r, CAST(greatest(0, least(239, ceil((by_ + bh) * 240))) AS INT) AS m FROM b)
      SELECT p_partkey, round(bx, 6) AS bx, round(by_, 6) AS by, round(bw, 6) AS bw, round(bh, 6) AS bh, l AS left_px, t AS top_px, CASE WHEN r <= l THEN least(319, l + 1) ELSE r END AS right_px, CASE WHEN m <= t THEN least(239, t + 1) ELSE m END AS bottom_px, round(10 + bx * 80, 6) AS back_x FROM q""",
    "predicted_format": f"""WITH {X.STEPS}, k AS (SELECT ep, step, ([4, 0, 1, 8, 9, 3, 5])[CAST(pk % 7 + 1 AS INT)] AS k, xi / 100.0::DOUBLE AS x, yi / 100.0::DOUBLE AS y, type_text FROM steps)
      SELECT ep, step, CAST(CASE WHEN k IN (4, 0, 1, 8, 9) THEN 4 ELSE k END AS INT) AS type_id, CASE k WHEN 4 THEN y WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0.2::DOUBLE WHEN 8 THEN 0.5::DOUBLE WHEN 9 THEN 0.5::DOUBLE ELSE -1 END AS touch_y, CASE k WHEN 4 THEN x WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 8 THEN 0.2::DOUBLE WHEN 9 THEN 0.8::DOUBLE ELSE -1 END AS touch_x,
        CASE k WHEN 4 THEN y WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 8 THEN 0.5::DOUBLE WHEN 9 THEN 0.5::DOUBLE ELSE -1 END AS lift_y, CASE k WHEN 4 THEN x WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 8 THEN 0.8::DOUBLE WHEN 9 THEN 0.2::DOUBLE ELSE -1 END AS lift_x, CASE WHEN k = 3 THEN lower(type_text) ELSE '' END AS typed FROM k""",
    "chosen_ids": f"{_Q} SELECT qid FROM qa WHERE qid % 2 = 0 AND pred <> truth AND qid <> 8",
    "sampled_captions": f"{_NARR} SELECT video_id, 'frame ' || (r + 1) AS frame, role AS caption FROM n0 WHERE r % 3 = 0",
    "first_non_empty": f"{_F} SELECT video, arg_min(event_type, idx) AS kind FROM frames WHERE event_type IN ('error', 'signup') GROUP BY video",
    "selected_segments": f"{_F}, g AS (SELECT video, idx AS s, lead(idx) OVER (PARTITION BY video ORDER BY idx) AS e FROM frames WHERE event_type = 'click'), c AS (SELECT video, idx AS s, lead(idx) OVER (PARTITION BY video ORDER BY idx) AS e FROM frames WHERE event_type = 'click' AND (k < 50 OR idx % 2 = 0)) SELECT video, s AS seg_start, e AS seg_end FROM g JOIN c USING (video, s, e) WHERE e IS NOT NULL",
    "schema_union": f"{_Q} SELECT qid, CASE WHEN qid % 2 = 0 THEN n_chars END AS steps, CASE WHEN qid % 2 = 1 THEN pred END AS forced FROM qa",
    "scene_jobs": f"{_F}, e AS (SELECT video, idx, CAST(row_number() OVER (PARTITION BY video ORDER BY idx) - 1 AS INT) AS i, first(idx) OVER (PARTITION BY video ORDER BY idx) AS f FROM frames WHERE event_type = 'error') SELECT video AS video_id, TRUE AS ok, i, idx * 0.5::DOUBLE AS at_sec, CAST(CASE WHEN i < 3 THEN idx ELSE f END * 10 AS INT) AS box FROM e WHERE video % 3 > 0 UNION ALL SELECT DISTINCT video, FALSE, CAST(NULL AS INT), CAST(NULL AS DOUBLE), CAST(NULL AS INT) FROM e WHERE video % 3 = 0",
    "tags": "SELECT p_partkey, translate(p_brand || '/' || p_name || ':1', '/ :', '___') AS tag FROM part",
}
