"""Lineage cuts in the folder shared by the whole cluster (``spark.checkpoint.dir``)."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; only where the setting is absent in a local session (tests) an own one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Texts and packed rows may be long, so Arrow batches between the JVM and Python carry no more than ``rows`` rows, and no
    further row from ``size`` bytes on. A session's setting (Spark has none for a single plan); only ever lowered."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(re.match(r"-?\d+", spark.conf.get(key))[0]) if re.fullmatch(r"-?\d+b?", spark.conf.get(key), re.I) else 0
        if now <= 0 or now > most:
            spark.conf.set(key, most)


class Scratch:
    """Written intermediate tables: a lost executor costs a re-read, never a recomputation of the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        small_batches(spark)

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def cut(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def free(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            if path := getattr(df, "scratch_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)

    def sweep(self, *frames: DataFrame) -> None:
        """As ``free``, and let Spark delete the shuffle files of plans that have ended: it does so only when the driver collects
        its garbage, which a long job of large shuffles cannot wait for."""
        self.free(*frames)
        gc.collect()
        self.spark._jvm.System.gc()


#: Ids that are sent to every task at most: 8 MB.
FEW = 1 << 20


def semi(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in ``ids``, a written table: by broadcast if it has no more than FEW rows, so
    that ``df`` isn't shuffled, else by a shuffled join."""
    return df.join(F.broadcast(ids) if ids.count() <= FEW else ids, column, "left_semi")
