"""A checkpoint of finished items that a repeated write leaves as it was.

Each batch has a name and is written to a folder of its own; it counts once a manifest names it, and a manifest is a small
file that appears whole. So a batch that a driver writes again is left alone, one that broke off is no part of what is
read, and compaction changes which folders are read, never what is read."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from keyframe.streaming import shared


class Checkpoint:
    """Batches under ``root``, by one writer at a time; readers may be many."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifests(self) -> list[str]:
        return [n for n in shared.names(self.spark, f"{self.root}/manifest") if n.isdigit()]

    def batches(self) -> dict[str, str]:
        """The folder of each batch that counts; batches that were merged share one."""
        found = self._manifests()
        return json.loads(shared.get(self.spark, f"{self.root}/manifest/{found[-1]}")) if found else {}

    def _publish(self, batches: dict[str, str]) -> None:
        found = self._manifests()
        n = int(found[-1]) + 1 if found else 0
        if not shared.put(self.spark, f"{self.root}/manifest/{n:012d}", json.dumps(batches)):
            raise RuntimeError(f"another writer has published to {self.root} meanwhile")

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Add the rows of a batch; False, and nothing is done, if a batch of this name counts already."""
        now = self.batches()
        if batch in now:
            return False
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        self._publish(now | {batch: folder})
        return True

    def read(self) -> DataFrame | None:
        """The rows of all batches; None before the first."""
        folders = sorted(set(self.batches().values()))
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.root}/{f}" for f in folders)) if folders else None

    def compact(self, files: int = 1) -> None:
        """All batches in one folder of about ``files`` files. Older folders stay for readers of older manifests."""
        now = self.batches()
        if len(set(now.values())) > 1:
            folder = f"data/{uuid.uuid4().hex}"
            self.read().repartition(files).write.parquet(f"{self.root}/{folder}")
            self._publish(dict.fromkeys(now, folder))

    def clean(self) -> int:
        """Delete what the latest manifest doesn't name: merged folders, batches that broke off, older manifests. The number of
        folders that went."""
        keep, gone = {f.split("/")[1] for f in self.batches().values()}, 0
        for name in shared.names(self.spark, f"{self.root}/data"):
            if name not in keep:
                shared.remove(self.spark, f"{self.root}/data/{name}")
                gone += 1
        for name in self._manifests()[:-1]:
            shared.remove(self.spark, f"{self.root}/manifest/{name}")
        return gone
