"""From scored answers to reports: best answer of a step, class report, task means, episode completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyframe.functions import actions as A


def scored(steps: DataFrame) -> DataFrame:
    """One row per step and acceptable answer of ``steps(..., reply, answers array<struct>)``, with score and type."""
    keys = [c for c in steps.columns if c not in ("reply", "answers")]
    rows = steps.select(*keys, A.parse_response(F.col("reply")).alias("p"), F.posexplode("answers").alias("pos", "g"))
    p, g = F.col("p"), F.col("g")
    ok = (p["type"] == g["type"]) & ~p["error"]
    return rows.select(*keys, "pos", p["type"].alias("pred_type"), F.when(p["error"], "None").otherwise(g["type"]).alias("gt_type"), ok.alias("type_ok"), A.step_score(p, g).alias("score"))


def best(steps: DataFrame, keys: list[str]) -> DataFrame:
    """The best answer of each step; of equal scores the last. One aggregate, combined before its shuffle."""
    top = scored(steps).groupBy(*keys).agg(F.max(F.struct("score", "pos", "gt_type", "pred_type", "type_ok")).alias("b"))
    return top.select(*keys, "b.score", "b.gt_type", "b.pred_type", "b.type_ok")


def class_report(result: DataFrame) -> DataFrame:
    """Count, mean score and mean type accuracy of each class; classes without steps are zero."""
    spark = result.sparkSession
    got = result.groupBy("gt_type").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.avg(F.col("type_ok").cast("double")), 6).alias("type_acc"))
    known = spark.createDataFrame([(c,) for c in A.CLASSES], "gt_type string")
    return known.join(got, "gt_type", "left").select("gt_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"), F.coalesce("type_acc", F.lit(0.0)).alias("type_acc"))


def completion(result: DataFrame, task: str, episode: str) -> DataFrame:
    """Mean over a task's episodes of the share of steps with a score."""
    per = result.groupBy(task, episode).agg(F.avg((F.col("score") > 0).cast("double")).alias("c"))
    return per.groupBy(task).agg(F.round(F.avg("c"), 6).alias("completion"), F.count("*").alias("episodes"))
