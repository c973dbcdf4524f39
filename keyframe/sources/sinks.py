"""Writers: predictions, metrics, leaderboards, submissions, frame records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def metrics_csv(long: DataFrame, path: str, names: list[str], run: dict[str, object] | None = None) -> None:
    """Task by metric with a header, then the settings of the run; ``names`` is the union of metric names, so that no pass is
    spent on it."""
    wide = long.groupBy("task").pivot("metric", sorted(names)).agg(F.first("value"))
    for k, v in (run or {}).items():
        wide = wide.withColumn(k, F.lit(str(v)))
    wide.write.mode("overwrite").option("header", "true").csv(path)


def board_json(board: DataFrame, path: str) -> None:
    board.select(F.to_json(F.struct(*board.columns)).alias("value")).write.mode("overwrite").text(path)


def results(df: DataFrame, path: str) -> None:
    """A folder per method and dataset."""
    df.write.mode("overwrite").partitionBy("method", "dataset").json(path)


def frame_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("shard").json(path)


def append_batch(df: DataFrame, path: str) -> None:
    """A checkpoint of finished items: each call appends a part."""
    df.write.mode("append").parquet(path)


def lines(rows: DataFrame, path: str) -> None:
    """``rows(number, line)`` as text in order; a report is a few lines, so one file holds it."""
    rows.orderBy("number").select("line").coalesce(1).write.mode("overwrite").text(path)


def board_csv(rows: DataFrame, path: str) -> None:
    """A leaderboard with a header, in order of its column ``number``; a row for each model and mode, so one file."""
    rows.orderBy("number").drop("number").coalesce(1).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def submission(rows: DataFrame, path: str, key: str = "qid", value: str = "answer") -> None:
    """One JSON object a line with the question and its answer, none answered as 0."""
    rows.select(F.to_json(F.struct(F.col(key).cast("string").alias("id"), F.greatest(value, F.lit(0)).alias("answer"))).alias("value")).write.mode("overwrite").text(path)


def annotations(rows: DataFrame, path: str) -> None:
    """``rows(video_id, task, title, step, action)`` as a JSON object for each video, its steps in order."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("step", "action"))), lambda x: x["action"])
    rows.groupBy("video_id", "task", "title").agg(steps.alias("steps")).write.mode("overwrite").json(path)
