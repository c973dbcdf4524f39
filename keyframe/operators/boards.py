"""Leaderboards: from a row of metrics for each model and mode to ordered tables as text.

``runs`` has model, mode, acc, type_acc, completion, images, total_steps and a score for each class (as the log reader
gives them); missing metrics count as 0 in tables, and models come by accuracy, ties by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyframe.functions.answers import percent
from keyframe.sources.readers import BASE_MODE, CLASSES, VIDEO_MODE

#: The column heads of the tables.
_SCORES = [f"{c.lower()}_score" for c in CLASSES]
_HEAD = ["Acc.(%)", "Type Acc.(%)", *CLASSES, "Comp.(%)", "Eff.↓"]


def improvement(video: Column, base: Column) -> Column:
    """(video - base) / base; null where either is missing or the base is 0."""
    return F.when(base != 0, (video - base) / base)


def both_modes(runs: DataFrame) -> DataFrame:
    """``runs`` with pir, the improvement of a model's video mode over its base mode, and best, its best accuracy."""
    by = Window.partitionBy("model")
    of = lambda mode: F.max(F.when(F.col("mode") == mode, F.col("acc"))).over(by)
    rows = runs.where(F.col("mode").isin(BASE_MODE, VIDEO_MODE)).withColumn("base_acc", of(BASE_MODE)).withColumn("video_acc", of(VIDEO_MODE))
    best = F.greatest(F.coalesce("base_acc", F.lit(0.0)), F.coalesce("video_acc", F.lit(0.0)))
    return rows.withColumn("pir", F.when(F.col("mode") == VIDEO_MODE, improvement(F.col("video_acc"), F.col("base_acc")))).withColumn("best", best)


def _line(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _cells(images: str) -> list[Column]:
    return [percent(F.col("acc")), percent(F.col("type_acc")), *(percent(F.col(c)) for c in _SCORES), percent(F.col("completion")), F.format_string(images, F.coalesce("images", F.lit(0.0)))]


def markdown(runs: DataFrame, title: str = "Leaderboard") -> DataFrame:
    """(number, line): a table for each mode and one of both, in Markdown."""
    spark = runs.sparkSession
    rows = both_modes(runs)
    pir = F.when(F.col("pir").isNull(), "—").otherwise(F.format_string("%.3f", F.col("pir")))
    base, video = rows.where(F.col("mode") == BASE_MODE), rows.where(F.col("mode") == VIDEO_MODE)
    place = F.row_number().over(Window.orderBy(F.desc(F.coalesce("acc", F.lit(0.0))), "model"))  # models: a handful of rows
    one = base.select(F.lit(1).alias("part"), (10 * place).cast("long").alias("at"), _line(F.col("model"), *_cells("%.0f")).alias("line"))
    two = video.select(F.lit(2).alias("part"), (10 * place).cast("long").alias("at"), _line(F.col("model"), *_cells("%.2f"), pir).alias("line"))
    order = rows.groupBy("model").agg(F.max(F.when(F.col("mode") == VIDEO_MODE, F.coalesce("acc", F.lit(0.0)))).alias("v"))
    order = order.select("model", F.row_number().over(Window.orderBy(F.desc(F.coalesce("v", F.lit(0.0))), "model")).alias("m"))
    of_video = F.col("mode") == VIDEO_MODE
    cells = [F.when(of_video, v).otherwise(b) for b, v in zip(_cells("%.0f"), _cells("%.2f"))]
    three = rows.join(order, "model").select(F.lit(3).alias("part"), (10 * F.col("m") + of_video.cast("int")).cast("long").alias("at"), _line(F.when(of_video, "").otherwise(F.col("model")), F.when(of_video, "Uniform10").otherwise("No Video"), *cells, F.when(of_video, pir).otherwise("—")).alias("line"))
    heads = [(0, 0, f"# {title}"), (0, 1, "")]
    for part, name, cols in ((1, "No Video Input", ["Method", *_HEAD]), (2, "With Video Input", ["Method", *_HEAD, "PIR"]), (3, "Combined", ["Method", "Mode", *_HEAD, "PIR"])):
        heads += [(part, -4, f"## {name}"), (part, -3, ""), (part, -2, "| " + " | ".join(cols) + " |"), (part, -1, "|" + "|".join([":---:"] * len(cols)) + "|"), (part, 1 << 40, "")]
    fixed = spark.createDataFrame(heads, "part int, at long, line string")
    every = fixed.unionByName(one).unionByName(two).unionByName(three)
    return every.select(F.row_number().over(Window.orderBy("part", "at")).alias("number"), "line")


def table(runs: DataFrame) -> DataFrame:
    """(number, Model, Mode, ...): models by best accuracy, the base mode before the video mode, numbers as text."""
    rows = both_modes(runs)
    of_video = F.col("mode") == VIDEO_MODE
    text = lambda c, f="%.4f": F.format_string(f, F.coalesce(c, F.lit(0.0)).cast("double"))
    number = F.row_number().over(Window.orderBy(F.desc("best"), "model", of_video))
    names = [("Acc", "acc"), ("Type_Acc", "type_acc"), *((f"{c}_Score", f"{c.lower()}_score") for c in CLASSES), ("Comp", "completion")]
    return rows.select(number.alias("number"), F.col("model").alias("Model"), F.when(of_video, "Uniform10").otherwise("No Video").alias("Mode"), *(text(F.col(c)).alias(n) for n, c in names), text(F.col("images"), "%.2f").alias("Eff"), F.when(F.col("pir").isNull(), "").otherwise(F.format_string("%.4f", F.col("pir"))).alias("PIR"), F.coalesce(F.col("total_steps").cast("string"), F.lit("")).alias("Total_Steps"))


def console(results: DataFrame, width: int = 40) -> DataFrame:
    """(number, line) of ``results(display, dataset, accuracy, avg_frames, error)``: a padded line for each result, by name;
    those that didn't read are warned about."""
    frames = F.when(F.col("avg_frames").isNull(), "N/A").otherwise(F.format_string("%.1f", F.col("avg_frames")))
    good = F.concat(F.lit("  "), F.rpad("display", width, " "), F.lit(" "), F.rpad("dataset", 20, " "), F.lit(" "), F.rpad(F.coalesce("accuracy", F.lit("N/A")), 12, " "), F.lit(" "), F.rpad(frames, 10, " "))
    line = F.when(F.col("error"), F.concat(F.lit("  [WARN] "), F.col("method"), F.lit("/"), F.col("dataset"))).otherwise(good)
    return results.select(F.row_number().over(Window.orderBy("method", "dataset")).alias("number"), line.alias("line"))


def summary_log(best: DataFrame, start: Column, end: Column) -> DataFrame:
    """(number, line): the lines of an evaluation log for one task's best answers(gt_type, type_ok, score), which the log reader
    reads back; classes without steps are given as 0."""
    spark = best.sparkSession
    a = best.agg(F.count("*").alias("n"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("s"), F.coalesce(F.avg(F.col("type_ok").cast("double")), F.lit(0.0)).alias("t"))
    from keyframe.functions.answers import elapsed

    head = a.select(F.explode(F.array(*(F.struct(F.lit(i).alias("number"), x.alias("line")) for i, x in enumerate([F.format_string("%-20s | %-10d", F.lit("Total Steps"), F.col("n")), F.format_string("%-20s | %-10.4f", F.lit("Overall Score"), F.col("s")), F.format_string("%-20s | %-10.4f", F.lit("Overall Type Acc"), F.col("t")), F.format_string("[Overall Avg Score]: %.4f", F.col("s")), F.concat(F.lit("  Time Elapsed     : "), elapsed(start, end))])))).alias("x")).select("x.*")
    known = spark.createDataFrame([(i, c) for i, c in enumerate(CLASSES)], "i int, gt_type string")
    by = best.groupBy("gt_type").agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg(F.col("type_ok").cast("double")).alias("t"))
    rows = known.join(by, "gt_type", "left").select((F.col("i") + 10).alias("number"), F.format_string("%-12s | %-6d | %-15.4f | %-12.4f", "gt_type", F.coalesce("n", F.lit(0)), F.coalesce("s", F.lit(0.0)), F.coalesce("t", F.lit(0.0))).alias("line"))
    return head.unionByName(rows)
