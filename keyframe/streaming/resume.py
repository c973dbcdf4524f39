"""Resuming: what is done is left out, what comes in is appended, later rows win. The stream form does the same to files
as they arrive, once through (availableNow)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Last writer wins; one aggregate over both."""
    cols = [c for c in old.columns if c != key]
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    top = both.groupBy(key).agg(F.max(F.struct("__v", *cols)).alias("r"))
    return top.select(key, *(F.col(f"r.{c}").alias(c) for c in cols))


def run_available(spark, source: str, schema: str, work, out: str, checkpoint: str) -> None:
    """Apply ``work`` to the files of ``source`` not yet seen, appending to ``out``; restarts lose and repeat nothing."""
    stream = spark.readStream.schema(schema).json(source)

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
