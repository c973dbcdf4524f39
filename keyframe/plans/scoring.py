"""Queries on replies, ground truth and step scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyframe.functions import actions as A
from keyframe.operators import scoring as S
from keyframe.operators import timeline as T

from . import surrogates as X

_ROWS = f"WITH {X.STEPS}"
_PARSED = f"WITH {X.STEPS}, {X.PARSED}"
_BEST = f"WITH {X.STEPS}, {X.PARSED}, {X.GROUND}"


def parse_response(spark, d):
    s = X.steps(spark, d).select("ep", "step", A.parse_response(F.col("reply")).alias("p"))
    return s.select("ep", "step", F.col("p.type").alias("p_type"), F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("p.x2").alias("px2"), F.col("p.y2").alias("py2"), F.col("p.text").alias("ptext"), F.col("p.key").alias("pkey"))


def normalise_gt(spark, d):
    s = X.ground(X.steps(spark, d))
    return s.groupBy("type_id", "label", F.col("g.type").alias("g_type"), F.col("g.key").alias("g_key")).agg(F.count("*").alias("n"))


def history_string(spark, d):
    s = X.ground(X.steps(spark, d))
    g = F.col("g")
    return s.select("ep", "step", A.history_text(F.col("type_id"), g["type"], g["x"], g["y"], g["x2"], g["y2"], F.col("type_text")).alias("action"))


def text_similarity(spark, d):
    p = X.table(spark, d, "part")
    a, b = F.col("p_name"), F.col("p_type")
    return p.select("p_partkey", F.levenshtein(F.lower(a), F.lower(b)).alias("dist"), F.round(A.text_similarity(a, b), 6).alias("sim"))


def scroll_direction(spark, d):
    c = [F.col(x) for x in ("xi", "yi", "x2i", "y2i")]  # whole hundredths compare exactly
    return X.steps(spark, d).groupBy(A.scroll_direction(*c).alias("direction")).agg(F.count("*").alias("n"))


def point_in_box(spark, d):
    """Flat box lists of one or two boxes in hundredths, cut into fours."""
    s = X.steps(spark, d)
    flat = F.concat(F.array(F.lit(25), F.lit(25), F.lit(50), F.lit(50)), F.when(F.col("pk") % 2 == 0, F.array("yi", "xi", F.lit(3), F.lit(3))).otherwise(F.array("yi")))
    return s.select("ep", "step", A.in_any_box(F.col("pxi"), F.col("yi"), A.chunk_boxes(flat)).alias("hit"), F.size(A.chunk_boxes(flat)).alias("n_boxes"))


def box_enlarge_match(spark, d):
    s = X.ground(X.steps(spark, d))
    g = F.col("g")
    a = F.struct(F.col("type_id").alias("type_id"), g["x"].alias("x"), g["y"].alias("y"), g["x2"].alias("x2"), g["y2"].alias("y2"))
    b = F.struct((F.col("type_id") + F.when(F.col("pk") % 9 == 0, 1).otherwise(0)).alias("type_id"), (F.col("pxi") / 100).alias("x"), (F.col("yi") / 100).alias("y"), (F.col("pxi") / 100).alias("x2"), F.when(F.col("sk") % 3 == 0, F.col("yi") / 100).otherwise(F.col("yi") / 100 + 0.25).alias("y2"))
    boxes = F.array(F.struct((F.col("yi") / 100 - 0.0625).alias("y"), (F.col("xi") / 100 - 0.0625).alias("x"), F.lit(0.125).alias("h"), F.lit(0.125).alias("w")))
    return s.select(a.alias("a"), b.alias("b"), boxes.alias("v")).select(A.actions_match(F.col("a"), F.col("b"), F.col("v")).alias("same")).groupBy("same").agg(F.count("*").alias("n"))


def _answered(spark, d):
    return X.answered(X.steps(spark, d)).select("ep", "step", "ls", "sk", "reply", "answers")


def score_steps(spark, d):
    return S.scored(_answered(spark, d)).select("ep", "step", "pos", "pred_type", "gt_type", "type_ok", F.round("score", 9).alias("score"))


def _best(spark, d):
    return S.best(_answered(spark, d), ["ep", "step", "ls", "sk"])


def best_answer(spark, d):
    return _best(spark, d).select("ep", "step", "gt_type", "pred_type", "type_ok", F.round("score", 9).alias("score"))


def class_report(spark, d):
    return S.class_report(_best(spark, d))


def macro_score(spark, d):
    """Mean of task means; a task for each seventh supplier."""
    t = _best(spark, d).groupBy((F.col("sk") % 7).alias("task")).agg(F.avg("score").alias("a"), F.avg(F.col("type_ok").cast("double")).alias("t"))
    return t.agg(F.round(F.avg("a"), 6).alias("acc"), F.round(F.avg("t"), 6).alias("type_acc"), F.count("*").alias("tasks"))


def episode_completion(spark, d):
    return S.completion(_best(spark, d), "ls", "ep")


def images_per_step(spark, d):
    s = X.steps(spark, d).select("ls", F.when(F.col("pk") % 10 == 0, None).otherwise(F.col("pk") % 11).alias("n"))
    return s.groupBy("ls").agg(F.round(F.avg(F.coalesce("n", F.lit(1))), 6).alias("images"))


def last_k_history(spark, d):
    """History over all steps, then only those whose image exists."""
    s = X.steps(spark, d).select("ep", "step", "pk", F.concat_ws(":", "type_id", "xi", "yi").alias("a"))
    return T.history(s, ["ep"], ["step"], "a", 2).where("pk % 3 <> 0").select("ep", "step", "history")


def aitw_format(spark, d):
    """Scroll labels become fixed vectors, points go (y, x), typed text goes lower case."""
    s = X.steps(spark, d)
    y, x = (F.when(F.col("label") == "click", F.col(c)).when(F.col("label").isin("scroll up", "scroll down"), F.lit(v)).otherwise(F.lit(w)) for c, v, w in (("yi", 80, 50), ("xi", 50, 20)))
    return s.groupBy("type_id", y.alias("touch_y"), x.alias("touch_x"), F.when(F.col("type_id") == 3, F.lower("type_text")).alias("txt")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (parse_response, normalise_gt, history_string, text_similarity, scroll_direction, point_in_box, box_enlarge_match, score_steps, best_answer, class_report, macro_score, episode_completion, images_per_step, last_k_history, aitw_format)}
SQL = {
    "parse_response": f"{_PARSED} SELECT ep, step, p_type, px, py, px2, py2, ptext, pkey FROM parsed",
    "normalise_gt": f"{_BEST} SELECT type_id, label, g_type, g_key, count(*) AS n FROM g0 GROUP BY ALL",
    "history_string": f"""{_BEST} SELECT ep, step, CASE g_type WHEN 'CLICK' THEN printf('CLICK(%.3f, %.3f)', gx, gy) WHEN 'SCROLL' THEN printf('SCROLL(%.3f, %.3f, %.3f, %.3f)', gx, gy, gx2, gy2)
      WHEN 'TYPE' THEN 'TYPE("' || type_text || '")' WHEN 'PRESS' THEN 'PRESS("' || g_key || '")' WHEN 'ZOOM' THEN 'ZOOM()' ELSE CASE WHEN type_id IN (10, 11) THEN 'FINISH()' ELSE 'UNKNOWN()' END END AS action FROM g0""",
    "text_similarity": "SELECT p_partkey, CAST(levenshtein(lower(p_name), lower(p_type)) AS INT) AS dist, round(1.0::DOUBLE - levenshtein(lower(trim(p_name)), lower(trim(p_type))) / greatest(length(trim(p_name)), length(trim(p_type)))::DOUBLE, 6) AS sim FROM part",
    "scroll_direction": f"{_ROWS} SELECT CASE WHEN abs(y2i - yi) > abs(x2i - xi) THEN CASE WHEN y2i < yi THEN 'scroll down' ELSE 'scroll up' END WHEN x2i > xi THEN 'scroll left' ELSE 'scroll right' END AS direction, count(*) AS n FROM steps GROUP BY ALL",
    "point_in_box": f"{_ROWS} SELECT ep, step, (pxi BETWEEN 25 AND 75 AND yi BETWEEN 25 AND 75) OR (pk % 2 = 0 AND pxi BETWEEN xi AND xi + 3) AS hit, CAST(CASE WHEN pk % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n_boxes FROM steps",
    "box_enlarge_match": f"""{_BEST}, m0 AS (SELECT type_id AS ta, type_id + CASE WHEN pk % 9 = 0 THEN 1 ELSE 0 END AS tb, gx AS ax, gy AS ay, gx2 AS ax2, gy2 AS ay2, pxi / 100.0::DOUBLE AS bx, gy AS by_, pxi / 100.0::DOUBLE AS bx2, CASE WHEN sk % 3 = 0 THEN gy ELSE gy + 0.25::DOUBLE END AS by2,
        greatest(0::DOUBLE, gy - 0.0625::DOUBLE - 1.4::DOUBLE * 0.125::DOUBLE / 2) AS vy, greatest(0::DOUBLE, gx - 0.0625::DOUBLE - 1.4::DOUBLE * 0.125::DOUBLE / 2) AS vx, least(1::DOUBLE, 2.4::DOUBLE * 0.125::DOUBLE) AS vh FROM g0),
      m1 AS (SELECT *, sqrt((ax - ax2) * (ax - ax2) + (ay - ay2) * (ay - ay2)) <= 0.04::DOUBLE AS tap_a, sqrt((bx - bx2) * (bx - bx2) + (by_ - by2) * (by_ - by2)) <= 0.04::DOUBLE AS tap_b FROM m0)
      SELECT CASE WHEN NOT (ta = 4 AND tb = 4) THEN ta = tb WHEN tap_a <> tap_b THEN FALSE WHEN tap_a THEN (ax BETWEEN vx AND vx + vh AND ay BETWEEN vy AND vy + vh AND bx BETWEEN vx AND vx + vh AND by_ BETWEEN vy AND vy + vh) OR sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) <= 0.14::DOUBLE
        ELSE (abs(ax2 - ax) > abs(ay2 - ay)) = (abs(bx2 - bx) > abs(by2 - by_)) END AS same, count(*) AS n FROM m1 GROUP BY ALL""",
    "score_steps": f"{_BEST} SELECT ep, step, CAST(pos AS INT) AS pos, pred_type, gt_type, type_ok, round(score, 9) AS score FROM scored",
    "best_answer": f"{_BEST} SELECT ep, step, gt_type, pred_type, type_ok, round(score, 9) AS score FROM best",
    "class_report": f"""{_BEST}, c(gt_type) AS (VALUES ('CLICK'), ('SCROLL'), ('TYPE'), ('PRESS'), ('ZOOM'), ('FINISH')),
      a AS (SELECT gt_type, count(*) AS n, round(avg(score), 6) AS s, round(avg(CASE WHEN type_ok THEN 1.0::DOUBLE ELSE 0 END), 6) AS t FROM best GROUP BY gt_type)
      SELECT c.gt_type, coalesce(n, 0) AS n, coalesce(s, 0) AS avg_score, coalesce(t, 0) AS type_acc FROM c LEFT JOIN a ON a.gt_type = c.gt_type""",
    "macro_score": f"{_BEST}, t AS (SELECT sk % 7 AS task, avg(score) AS a, avg(CASE WHEN type_ok THEN 1.0::DOUBLE ELSE 0 END) AS t FROM best GROUP BY ALL) SELECT round(avg(a), 6) AS acc, round(avg(t), 6) AS type_acc, count(*) AS tasks FROM t",
    "episode_completion": f"{_BEST}, e AS (SELECT ls, ep, avg(CASE WHEN score > 0 THEN 1.0::DOUBLE ELSE 0 END) AS c FROM best GROUP BY ALL) SELECT ls, round(avg(c), 6) AS completion, count(*) AS episodes FROM e GROUP BY ls",
    "images_per_step": f"{_ROWS} SELECT ls, round(avg(CASE WHEN pk % 10 = 0 THEN 1 ELSE pk % 11 END), 6) AS images FROM steps GROUP BY ls",
    "last_k_history": f"""{_ROWS}, h AS (SELECT ep, step, pk, lag(a, 1) OVER w AS h1, lag(a, 2) OVER w AS h2 FROM (SELECT *, type_id || ':' || xi || ':' || yi AS a FROM steps) WINDOW w AS (PARTITION BY ep ORDER BY step))
      SELECT ep, step, CASE WHEN h1 IS NULL THEN 'None' WHEN h2 IS NULL THEN '1. ' || h1 ELSE '1. ' || h2 || chr(10) || '2. ' || h1 END AS history FROM h WHERE pk % 3 <> 0""",
    "aitw_format": f"{_ROWS} SELECT type_id, CASE WHEN label = 'click' THEN yi WHEN label IN ('scroll up', 'scroll down') THEN 80 ELSE 50 END AS touch_y, CASE WHEN label = 'click' THEN xi WHEN label IN ('scroll up', 'scroll down') THEN 50 ELSE 20 END AS touch_x, CASE WHEN type_id = 3 THEN lower(type_text) END AS txt, count(*) AS n FROM steps GROUP BY ALL",
}
