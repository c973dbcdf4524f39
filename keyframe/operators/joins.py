"""Joins on order: points in intervals, and the nearest point, without the pairs of a whole part.

Both deal a part's rows over buckets of the ordered column, so that one large part is worked on by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bucket of the ordered column in ``nearest``.
WIDTH = 1 << 12


def _level(size: Column) -> Column:
    """The power of two at or under a whole size of 1 or more."""
    return (F.length(F.bin(size)) - 1).cast("int")


def points_in_intervals(points: DataFrame, intervals: DataFrame, part: str, at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Every point (part, at, other columns) with each interval [start, end) of its part that holds it, and that interval's other
    columns.

    An interval stands in the two or three buckets that it touches of the power of two at or under its length; a point
    stands in one bucket of each power that occurs. So of the pairs that meet in a bucket about every third is one that is
    wanted, whatever the lengths. Intervals may overlap and repeat; empty ones and those with a null end hold nothing;
    parts join where they are equal, nulls nowhere. The powers, 64 at most, are looked up first."""
    whole = intervals.where(F.col(end) > F.col(start)).withColumn("level_", _level(F.col(end).cast("long") - F.col(start).cast("long")))
    levels = sorted(r[0] for r in whole.select("level_").distinct().collect())
    bucket = lambda c: F.call_function("shiftright", F.col(c).cast("long"), F.col("level_"))
    last = F.call_function("shiftright", F.col(end).cast("long") - 1, F.col("level_"))
    stood = whole.withColumn("bucket_", F.explode(F.sequence(bucket(start), last)))
    each = points.withColumn("level_", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("bucket_", bucket(at))
    met = each.join(stood, [part, "level_", "bucket_"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
    return met.drop("level_", "bucket_")


def nearest(asked: DataFrame, targets: DataFrame, part: str, at: str, target: str, width: int = WIDTH) -> DataFrame:
    """``asked`` with the target of its part that is nearest to ``at``, the smaller of two at the same distance; null where the
    part has none. Both columns are whole numbers; ``targets`` may repeat.

    One union of both in order: the last target up to a row and the first from it on. Buckets of ``width`` are ordered by
    themselves; what lies beyond comes from each bucket's least and greatest target, a row for each bucket."""
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    names = asked.columns
    rows = asked.select(F.col(part).alias("part_"), F.col(at).cast("long").alias("at_"), F.lit(None).cast("long").alias("to_"), F.struct(*names).alias("row_"))
    ends = targets.where(F.col(target).isNotNull()).select(F.col(part).alias("part_"), F.col(target).cast("long").alias("at_"), F.col(target).cast("long").alias("to_")).withColumn("row_", F.lit(None).cast(rows.schema["row_"].dataType))
    both = rows.unionByName(ends).withColumn("bucket_", bucket("at_"))
    order = Window.partitionBy("part_", "bucket_").orderBy("at_")  # a range frame, so that equal places count on either side
    both = both.withColumns({"low_": F.max("to_").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "high_": F.min("to_").over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))})
    each = Window.partitionBy("part_").orderBy("bucket_")
    beyond = both.groupBy("part_", "bucket_").agg(F.min("to_").alias("first_"), F.max("to_").alias("last_"))
    beyond = beyond.select("part_", "bucket_", F.max("last_").over(each.rowsBetween(Window.unboundedPreceding, -1)).alias("before_"), F.min("first_").over(each.rowsBetween(1, Window.unboundedFollowing)).alias("after_"))
    met = both.where("row_ is not null").join(beyond, ["part_", "bucket_"], "left")
    low, high = F.coalesce("low_", "before_"), F.coalesce("high_", "after_")
    best = F.when(low.isNull() | (high - F.col("at_") < F.col("at_") - low), high).otherwise(low)
    return met.select(*(F.col(f"row_.{n}").alias(n) for n in names), best.cast(targets.schema[target].dataType).alias(target))


def previous(rows: DataFrame, part: str, at: str, columns: list[str], width: int = WIDTH) -> DataFrame:
    """``rows`` with prev, a struct of ``columns`` of the row before in its part by the whole number ``at``; null for the first.

    As a window over the part, but a part is dealt over buckets of ``width``: what stands before a bucket's first row is the
    last row of the bucket before, of which there is one for each bucket. Of rows at the same place any comes first; nulls
    make a part like others, and null places come first."""
    held = F.struct(*columns)
    dealt = rows.withColumn("bucket_", F.coalesce(F.floor(F.col(at) / width).cast("long"), F.lit(-(2**63))))
    inner = F.lag(held).over(Window.partitionBy(part, "bucket_").orderBy(F.col(at).asc_nulls_first()))
    tails = dealt.groupBy(F.col(part).alias("part_"), F.col("bucket_").alias("to_")).agg(F.max_by(held, F.coalesce(F.col(at), F.lit(0))).alias("tail_"))
    tails = tails.select("part_", "to_", F.lag("tail_").over(Window.partitionBy("part_").orderBy("to_")).alias("before_"))
    met = dealt.withColumn("prev", inner).join(tails, F.col(part).eqNullSafe(F.col("part_")) & (F.col("bucket_") == F.col("to_")), "left")
    return met.select(*rows.columns, F.coalesce("prev", "before_").alias("prev"))


def leading(rows: DataFrame, part: str, at: str, take, width: int = WIDTH) -> DataFrame:
    """The first rows of each part by the whole number ``at``, as many as ``take`` says of the part's number of rows (a column).

    Buckets of ``width`` are counted first; those that lie behind the rows wanted are left out, and of the one in which these
    end the rows are numbered, so no part is sorted in one task. Places differ within a part; nulls make a part like
    others, and null places come first."""
    dealt = rows.withColumn("bucket_", F.coalesce(F.floor(F.col(at) / width).cast("long"), F.lit(-(2**63))))
    whole = Window.partitionBy("part_")
    count = dealt.groupBy(F.col(part).alias("part_"), F.col("bucket_").alias("to_")).agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(whole.orderBy("to_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    count = count.select("part_", "to_", before.alias("before_"), take(F.sum("n_").over(whole)).alias("take_")).where("before_ < take_")
    met = dealt.join(count, F.col(part).eqNullSafe(F.col("part_")) & (F.col("bucket_") == F.col("to_")))
    place = F.row_number().over(Window.partitionBy(part, "bucket_").orderBy(F.col(at).asc_nulls_first()))
    return met.withColumn("place_", place + F.col("before_")).where("place_ <= take_").select(*rows.columns)
