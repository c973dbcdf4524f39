"""Tables of a run that later steps and restarts read, in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keyframe-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, in order."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def put(spark: SparkSession, path: str, text: str) -> bool:
    """A small file, whole or not at all: written beside its place and renamed. False if there is one already."""
    p, fs = _path(spark, path)
    if fs.exists(p):
        return False
    beside, _ = _path(spark, f"{path}.new")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    return fs.rename(beside, p)


def get(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def once(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``; made and written only where that hasn't been done to the end."""
    if not written(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
