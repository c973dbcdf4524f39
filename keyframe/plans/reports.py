"""Queries on answers, accuracies and leaderboards."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keyframe.functions import answers as N
from keyframe.operators import boards as B
from keyframe.operators import scoring as S
from keyframe.sources import readers as R
from keyframe.streaming import shared

from . import scoring, surrogates as X

_TYPES = ["CH", "CW", "DC", "DL", "DO", "TC", "TN"]


def parse_letter(spark, d):
    q = X.qa(spark, d)
    letter = F.substring(F.lit("ABCDE"), (F.col("pred") + 1).cast("int"), 1)
    m = F.col("qid") % 7
    reply = F.when(F.col("pred") < 0, F.when(m > 3, "I pick A or B").otherwise(None)).when(m == 0, letter).when(m == 1, F.concat(F.lit("  ("), F.lower(letter), F.lit(") since"))).when(m == 2, F.concat(F.lit("The choice "), letter)).when(m == 3, F.concat(F.lit("Just "), letter)).when(m == 4, F.concat(F.lit("Answer: "), letter)).when(m == 5, F.concat(F.lit("My option:"), letter)).otherwise("no")
    return q.select("qid", N.parse_letter(reply).alias("answer"))


def _routes(spark, d):
    q = X.qa(spark, d)
    return q.select("qid", F.col("pred").cast("int").alias("s"), (F.col("n_chars") % 3 + 1).cast("int").alias("sc"), F.when(F.col("qid") % 4 == 0, F.col("pred")).otherwise(F.col("qid") % 5).cast("int").alias("r"), (F.col("qid") % 3 + 1).cast("int").alias("rc"))


_R = f"WITH {X.QA}, r AS (SELECT qid, CAST(pred AS INT) AS s, n_chars % 3 + 1 AS sc, CAST(CASE WHEN qid % 4 = 0 THEN pred ELSE qid % 5 END AS INT) AS r, qid % 3 + 1 AS rc FROM qa)"


def _combine(mode):
    def run(spark, d):
        return _routes(spark, d).select("qid", N.combine(mode, F.col("s"), F.col("sc"), F.lit(3), F.col("r"), F.col("rc"), F.lit(2)).alias("answer"))

    return run


_CASES = {
    "s": "WHEN s <> -1 AND sc >= 3 THEN s", "r": "WHEN r <> -1 AND rc >= 2 THEN r", "sr": "WHEN s <> -1 AND sc >= 3 THEN s WHEN r <> -1 AND rc >= 2 THEN r", "rs": "WHEN r <> -1 AND rc >= 2 THEN r WHEN s <> -1 AND sc >= 3 THEN s",
    "vote": "WHEN s = r THEN s", "vote_conf_and": "WHEN s = r AND sc >= 3 AND rc >= 2 THEN s", "vote_conf_or": "WHEN s = r AND (sc >= 3 OR rc >= 2) THEN s",
}


def staged_answer(spark, d):
    r = _routes(spark, d)
    loop = N.combine("vote_conf_and", F.col("s"), F.col("sc"), F.lit(3), F.col("r"), F.col("rc"), F.lit(2))
    got = lambda c: F.nullif(c, F.lit(-1))
    return r.select("qid", F.coalesce(got(loop), got(F.when(F.col("qid") % 2 == 0, F.col("r")).otherwise(-1)), got(F.col("s")), F.lit(-1)).alias("answer"))


def parse_json_answer(spark, d):
    q = X.qa(spark, d)
    m, n = F.col("qid") % 4, (F.col("n_chars") % 12 - 2).cast("string")
    reply = F.when(m == 0, F.concat(F.lit('```json\n{"final_answer": "'), n, F.lit('"}\n```'))).when(m == 1, F.concat(F.lit("so {'final_answer': '"), n, F.lit("'} it is"))).when(m == 2, F.concat(F.lit('{"final_answer": '), n, F.lit("}"))).otherwise("none")
    value = N.json_field(reply, "final_answer")
    return q.select("qid", N.answer(value, F.col("qid")).alias("answer"), N.confidence(value).alias("confidence"), N.first_digits(value).alias("digits"))


def qa_accuracy(spark, d):
    """All questions against predictions for some of them; a missing prediction is none, a surplus one plays no part."""
    gt = X.qa(spark, d).select("qid", "truth")
    pred = X.qa(spark, d).where("qid % 3 <> 0").select("qid", "pred").union(spark.createDataFrame([(-7, 1)], "qid long, pred long"))
    j = gt.join(pred, "qid", "left").select("truth", F.coalesce("pred", F.lit(-1)).alias("pred"))
    a = j.agg(F.count("*").alias("total"), F.count_if(F.col("truth") == F.col("pred")).alias("correct"), F.count_if(F.col("pred") == -1).alias("invalid"))
    return a.select("total", "correct", "invalid", F.round(F.try_divide("correct", F.col("total")), 6).alias("acc"), F.round(F.try_divide(F.col("correct") + 0.2 * F.col("invalid"), F.col("total")), 6).alias("acc_partial"))


def qa_by_type(spark, d):
    """Type (percent, zero-filled), category (fraction) and overall; TP counts as TN."""
    q = X.qa(spark, d).select(F.when(F.col("type") == "TP", "TN").otherwise(F.col("type")).alias("type"), (F.col("truth") == F.col("pred")).cast("int").alias("ok")).where(F.col("type") != "DC")
    g = q.withColumn("cat", F.substring("type", 1, 1)).groupingSets([["type"], ["cat"], []], "type", "cat").agg(F.count("*").alias("n"), F.sum("ok").alias("c"), F.grouping("type").alias("gt"), F.grouping("cat").alias("gc"))
    g = g.select(F.when(F.col("gt") == 0, F.concat(F.lit("type:"), "type")).when(F.col("gc") == 0, F.concat(F.lit("cat:"), "cat")).otherwise("all").alias("name"), "n", F.round(F.try_divide("c", "n") * F.when(F.col("gt") == 0, 100).otherwise(1), 6).alias("acc"))
    known = spark.createDataFrame([(f"type:{t}",) for t in _TYPES], "name string")
    zero = known.join(g, "name", "left_anti").select("name", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("acc"))
    return g.union(zero)


def caption_summary(spark, d):
    q = X.qa(spark, d)
    a = q.agg(F.count("*").alias("total"), F.count_if(F.col("pred") == -1).alias("no_answer"), F.count_if(F.col("pred") == F.col("truth")).alias("ok"), F.avg(F.when(F.col("pred") != -1, F.col("n_chars") % 40)).alias("f"))
    return a.select("total", "no_answer", F.round(F.try_divide(F.col("ok") + 0.2 * F.col("no_answer"), F.col("total")), 6).alias("acc_incl"), F.round(F.try_divide("ok", F.col("total") - F.col("no_answer")), 6).alias("acc_excl"), F.round("f", 6).alias("mean_frames"))


def accuracy_by_step(spark, d):
    q = X.qa(spark, d).select(F.when(F.col("pred") == -1, None).otherwise(F.concat((F.col("n_chars") % 4).cast("string"), F.lit("_"), F.when(F.col("qid") % 2 == 0, "s_qa").otherwise("s_r"))).alias("at_step"), (F.col("pred") == F.col("truth")).cast("int").alias("ok"))
    return q.where("at_step is not null").rollup("at_step").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("acc")).select(F.coalesce("at_step", F.lit("all")).alias("at_step"), "n", "acc")


def stop_reasons(spark, d):
    """Why runs stopped, and how many of these were right: results joined to the truths, none never right."""
    q = X.qa(spark, d)
    runs = q.select("qid", F.element_at(F.array(F.lit("max_frames"), F.lit("confident"), F.lit("stalled"), F.lit(None)), (F.col("n_chars") % 4 + 1).cast("int")).alias("r"), "pred", F.when(F.col("qid") % 6 == 0, None).otherwise(F.col("n_chars") % 16).alias("f"))
    q = runs.join(q.select("qid", "truth"), "qid", "left").withColumn("ok", F.coalesce((F.col("pred") == F.col("truth")) & (F.col("pred") != -1), F.lit(False)).cast("int"))
    return q.groupBy(F.coalesce("r", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"), F.sum("ok").alias("correct"), F.round(F.avg(F.coalesce("f", F.lit(0))), 6).alias("mean_frames"))


def run_means(spark, d):
    """Mean frames, steps and forced choices by category, missing values as 0; high relevances and progress as counts."""
    q = X.qa(spark, d)
    some = lambda c, m: F.when(F.col("qid") % m == 0, None).otherwise(c)
    mean = lambda c, n: F.round(F.avg(F.coalesce(c, F.lit(0))), 6).alias(n)
    return q.groupBy("lang").agg(mean(some(F.col("n_chars") % 17, 6), "frames"), mean(some(F.col("n_chars") % 5, 4), "steps"), mean(some(F.col("qid") % 3, 5), "forced"), F.count_if(F.col("n_chars") % 3 + 1 == 3).alias("high"), F.count_if(F.col("pred") != -1).alias("done"), F.count("*").alias("total"))


def submission_map(spark, d):
    """Answers to hand in, none as 0."""
    return X.qa(spark, d).select("lang", F.col("qid").cast("string").alias("qid"), F.greatest("pred", F.lit(0)).alias("answer"))


def _runs(spark, d):
    """A row of metrics for each model and mode, from scored steps: models by supplier, the base mode from open lines."""
    b = scoring._best(spark, d).select(F.concat(F.lit("m"), (F.col("sk") % 7).cast("string")).alias("model"), F.when(F.col("ls") == "O", R.BASE_MODE).otherwise(R.VIDEO_MODE).alias("mode"), "score", "type_ok", "gt_type")
    of = lambda c: F.avg(F.when(F.col("gt_type") == c, F.col("score"))).alias(f"{c.lower()}_score")
    return b.groupBy("model", "mode").agg(F.avg("score").alias("acc"), F.avg(F.col("type_ok").cast("double")).alias("type_acc"), *(of(c) for c in R.CLASSES), F.avg((F.col("score") > 0).cast("double")).alias("completion"), F.lit(1.0).alias("images"), F.count("*").cast("int").alias("total_steps"))


def board_markdown(spark, d):
    return B.markdown(_runs(spark, d))


def board_table(spark, d):
    return B.table(_runs(spark, d))


def _board(spark, d):
    best = scoring._best(spark, d).withColumn("model", (F.col("sk") % 7).cast("int"))
    p = best.groupBy("model").pivot("ls", ["O", "F"]).agg(F.avg("score").alias("acc"), F.count("score").alias("n"))
    o, f = F.round("O_acc", 6), F.round("F_acc", 6)
    return p.select("model", o.alias("base"), f.alias("video"), F.col("O_n").alias("base_n"), F.col("F_n").alias("video_n")).withColumn("pir", F.when(F.col("base") != 0, F.round((F.col("video") - F.col("base")) / F.col("base"), 4))).withColumn("best", F.greatest(F.coalesce("base", F.lit(0.0)), F.coalesce("video", F.lit(0.0))))


_BOARD = scoring._BEST + """, a AS (SELECT CAST(sk % 7 AS INT) AS model, round(avg(score) FILTER (ls = 'O'), 6) AS base, round(avg(score) FILTER (ls = 'F'), 6) AS video, count(*) FILTER (ls = 'O') AS base_n, count(*) FILTER (ls = 'F') AS video_n FROM best GROUP BY ALL),
  board AS (SELECT *, CASE WHEN base <> 0 THEN round((video - base) / base, 4) END AS pir, greatest(coalesce(base, 0), coalesce(video, 0)) AS best FROM a)"""


def leaderboard_pivot(spark, d):
    return _board(spark, d)


def leaderboard_ranked(spark, d):
    """Models by best accuracy, ties by number; a handful of rows, so one task ranks them."""
    from pyspark.sql import Window

    return _board(spark, d).select("model", "best", F.row_number().over(Window.orderBy(F.desc("best"), "model")).alias("place"))


def markdown_rows(spark, d):
    b = _board(spark, d)
    return b.select("model", F.concat(F.lit("| model-"), F.col("model").cast("string"), F.lit(" | "), F.round(F.col("base") * 10000).cast("long").cast("string"), F.lit(" | "), F.coalesce(F.round(F.col("pir") * 10000).cast("long").cast("string"), F.lit("-")), F.lit(" |")).alias("line"))


def metrics_wide(spark, d):
    """Task by class; the columns are the sorted union of the fixed class names and those that occur.

    Steps are scored once: the means by task and class are written, and give both the names and the table."""
    b = scoring._best(spark, d).withColumn("task", F.col("sk") % 7)
    means = shared.once(spark, f"{shared.folder(spark)}/metrics-{uuid.uuid4().hex}", lambda: b.groupBy("task", "gt_type").agg(F.round(F.avg("score"), 6).alias("score")))
    names = sorted({*R.CLASSES, *(r[0] for r in means.select("gt_type").where("gt_type is not null").distinct().collect())})
    wide = means.groupBy("task").pivot("gt_type", names).agg(F.first("score"))
    return wide.select("task", *(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"acc_{c.lower()}") for c in names))


def qa_prompt(spark, d):
    """A question with its five options, lettered, and the numbers of its images."""
    q = X.qa(spark, d)
    opts = F.transform(F.array(F.col("lang"), F.col("source"), F.col("type"), F.lit("all"), F.lit("none")), lambda o, i: F.concat(F.lit("("), F.substring(F.lit("ABCDE"), i + 1, F.lit(1)), F.lit(") "), o))
    images = F.when(F.col("n_chars") % 3 > 0, F.concat(F.lit("\nImages: "), F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n_chars") % 3), lambda i: F.concat(F.lit("#"), i.cast("string"))), " "))).otherwise("")
    return q.select(F.concat_ws("_", "lang", "qid").alias("item"), F.concat(F.lit("Question "), F.col("qid").cast("string"), F.lit("\n"), F.array_join(opts, "\n"), images).alias("prompt"))


_RUNS = (
    scoring._BEST
    + ", y AS (SELECT 'm' || (sk % 7) AS model, CASE ls WHEN 'O' THEN 'single' ELSE 'uniform10' END AS mode, avg(score) AS acc, avg(CASE WHEN type_ok THEN 1.0::DOUBLE ELSE 0 END) AS type_acc, "
    + ", ".join(f"coalesce(avg(score) FILTER (gt_type = '{c}'), 0) AS {c}" for c in R.CLASSES)
    + ", avg(CASE WHEN score > 0 THEN 1.0::DOUBLE ELSE 0 END) AS comp, count(*) AS n FROM best GROUP BY ALL), z AS (SELECT *, max(acc) FILTER (mode = 'single') OVER (PARTITION BY model) AS ba, max(acc) OVER (PARTITION BY model) AS best FROM y)"
)
_T4 = ", ".join(f"printf('%.4f', {c}) AS \"{n}\"" for n, c in [("Acc", "acc"), ("Type_Acc", "type_acc"), *((f"{c}_Score", c) for c in R.CLASSES), ("Comp", "comp")])
QUERIES = {f.__name__: f for f in (parse_letter, staged_answer, parse_json_answer, qa_accuracy, qa_by_type, caption_summary, accuracy_by_step, stop_reasons, run_means, submission_map, board_markdown, board_table, leaderboard_pivot, leaderboard_ranked, markdown_rows, metrics_wide, qa_prompt)} | {f"combine_answers_{m}": _combine(m) for m in N.MODES}
_Q = f"WITH {X.QA}"
SQL = {f"combine_answers_{m}": f"{_R} SELECT qid, CASE {_CASES[m]} ELSE -1 END AS answer FROM r" for m in N.MODES} | {
    "parse_letter": rf"""{_Q}, t AS (SELECT qid, pred, substring('ABCDE', CAST(pred + 1 AS INT), 1) AS l, qid % 7 AS m FROM qa),
      r AS (SELECT qid, trim(coalesce(CASE WHEN pred < 0 THEN CASE WHEN m > 3 THEN 'I pick A or B' END WHEN m = 0 THEN l WHEN m = 1 THEN '  (' || lower(l) || ') since' WHEN m = 2 THEN 'The choice ' || l WHEN m = 3 THEN 'Just ' || l WHEN m = 4 THEN 'Answer: ' || l WHEN m = 5 THEN 'My option:' || l ELSE 'no' END, '')) AS s FROM t),
      p AS (SELECT qid, CASE WHEN regexp_matches(s, '^[A-Ea-e]') THEN substring(s, 1, 1) WHEN regexp_matches(s, '\([A-E]\)', 'i') THEN regexp_extract(s, '\(([A-E])\)', 1, 'i') WHEN regexp_matches(s, '(?:answer|choice|option)[:\s]*[A-E]', 'i') THEN regexp_extract(s, '(?:answer|choice|option)[:\s]*([A-E])', 1, 'i')
        WHEN len(regexp_extract_all(s, '\b([A-E])\b', 1)) = 1 THEN regexp_extract(s, '\b([A-E])\b', 1) END AS l FROM r)
      SELECT qid, CAST(coalesce(instr('ABCDE', upper(l)) - 1, -1) AS INT) AS answer FROM p""",
    "staged_answer": f"{_R} SELECT qid, coalesce(nullif(CASE {_CASES['vote_conf_and']} ELSE -1 END, -1), nullif(CASE WHEN qid % 2 = 0 THEN r ELSE -1 END, -1), nullif(s, -1), -1) AS answer FROM r",
    "parse_json_answer": f"""{_Q}, t AS (SELECT qid, CASE WHEN qid % 4 < 3 THEN CAST(n_chars % 12 - 2 AS INT) END AS n FROM qa)
      SELECT qid, CAST(CASE WHEN n BETWEEN -1 AND 4 THEN n WHEN n IS NOT NULL THEN qid % 5 ELSE -1 END AS INT) AS answer, CASE WHEN n BETWEEN 1 AND 3 THEN n ELSE 1 END AS confidence, CASE WHEN abs(n) BETWEEN 0 AND 4 THEN abs(n) ELSE -1 END AS digits FROM t""",
    "qa_accuracy": f"{_Q}, j AS (SELECT truth, CASE WHEN qid % 3 <> 0 THEN pred ELSE -1 END AS p FROM qa), a AS (SELECT count(*) AS total, count(*) FILTER (truth = p) AS correct, count(*) FILTER (p = -1) AS invalid FROM j) SELECT total, correct, invalid, round(correct / total, 6) AS acc, round((correct + 0.2::DOUBLE * invalid) / total, 6) AS acc_partial FROM a",
    "qa_by_type": f"""{_Q}, t AS (SELECT CASE WHEN type = 'TP' THEN 'TN' ELSE type END AS type, CAST(truth = pred AS INT) AS ok FROM qa WHERE type <> 'DC'),
      k AS (SELECT unnest({_TYPES}) AS type)
      SELECT 'type:' || k.type AS name, count(ok) AS n, coalesce(round(avg(ok) * 100, 6), 0) AS acc FROM k LEFT JOIN t ON t.type = k.type GROUP BY k.type
      UNION ALL SELECT 'cat:' || substring(type, 1, 1), count(*), round(avg(ok), 6) FROM t GROUP BY ALL UNION ALL SELECT 'all', count(*), round(avg(ok), 6) FROM t""",
    "caption_summary": f"{_Q} SELECT count(*) AS total, count(*) FILTER (pred = -1) AS no_answer, round((count(*) FILTER (pred = truth) + 0.2::DOUBLE * count(*) FILTER (pred = -1)) / count(*), 6) AS acc_incl, round(count(*) FILTER (pred = truth) / count(*) FILTER (pred <> -1), 6) AS acc_excl, round(avg(n_chars % 40) FILTER (pred <> -1), 6) AS mean_frames FROM qa",
    "accuracy_by_step": f"{_Q}, t AS (SELECT (n_chars % 4) || '_' || CASE WHEN qid % 2 = 0 THEN 's_qa' ELSE 's_r' END AS at_step, CAST(pred = truth AS INT) AS ok FROM qa WHERE pred <> -1) SELECT coalesce(at_step, 'all') AS at_step, count(*) AS n, round(avg(ok), 6) AS acc FROM t GROUP BY ROLLUP (at_step)",
    "stop_reasons": f"{_Q} SELECT (['max_frames', 'confident', 'stalled', 'unknown'])[CAST(n_chars % 4 + 1 AS INT)] AS reason, count(*) AS n, count(*) FILTER (pred = truth AND pred <> -1) AS correct, round(avg(CASE WHEN qid % 6 = 0 THEN 0 ELSE n_chars % 16 END), 6) AS mean_frames FROM qa GROUP BY ALL",
    "submission_map": f"{_Q} SELECT lang, CAST(qid AS VARCHAR) AS qid, greatest(pred, 0) AS answer FROM qa",
    "leaderboard_pivot": f"{_BOARD} SELECT * FROM board",
    "leaderboard_ranked": f"{_BOARD} SELECT model, best, CAST(row_number() OVER (ORDER BY best DESC, model) AS INT) AS place FROM board",
    "markdown_rows": f"{_BOARD} SELECT model, '| model-' || model || ' | ' || CAST(round(base * 10000) AS BIGINT) || ' | ' || coalesce(CAST(CAST(round(pir * 10000) AS BIGINT) AS VARCHAR), '-') || ' |' AS line FROM board",
    "metrics_wide": f"{scoring._BEST} SELECT sk % 7 AS task, " + ", ".join(f"coalesce(round(avg(score) FILTER (gt_type = '{c}'), 6), 0) AS acc_{c.lower()}" for c in sorted([*R.CLASSES, "None", "UNKNOWN"])) + " FROM best GROUP BY ALL",
    "qa_prompt": f"{_Q} SELECT lang || '_' || qid AS item, 'Question ' || qid || chr(10) || '(A) ' || lang || chr(10) || '(B) ' || source || chr(10) || '(C) ' || type || chr(10) || '(D) all' || chr(10) || '(E) none' || CASE n_chars % 3 WHEN 1 THEN chr(10) || 'Images: #1' WHEN 2 THEN chr(10) || 'Images: #1 #2' ELSE '' END AS prompt FROM qa",
    "run_means": f"{_Q} SELECT lang, round(avg(CASE WHEN qid % 6 = 0 THEN 0 ELSE n_chars % 17 END), 6) AS frames, round(avg(CASE WHEN qid % 4 = 0 THEN 0 ELSE n_chars % 5 END), 6) AS steps, round(avg(CASE WHEN qid % 5 = 0 THEN 0 ELSE qid % 3 END), 6) AS forced, count(*) FILTER (n_chars % 3 = 2) AS high, count(*) FILTER (pred <> -1) AS done, count(*) AS total FROM qa GROUP BY lang",
    "board_table": f"{_RUNS} SELECT CAST(row_number() OVER (ORDER BY best DESC, model, mode) AS INT) AS number, model AS \"Model\", CASE mode WHEN 'single' THEN 'No Video' ELSE 'Uniform10' END AS \"Mode\", {_T4}, printf('%.2f', 1.0) AS \"Eff\", CASE WHEN mode = 'single' OR ba IS NULL OR ba = 0 THEN '' ELSE printf('%.4f', (acc - ba) / ba) END AS \"PIR\", CAST(n AS VARCHAR) AS \"Total_Steps\" FROM z",
}
