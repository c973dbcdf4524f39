"""Nested JSON by ranges of bytes, and checkpoints that survive repeats."""

import json
import random

import pytest
from pyspark.sql import functions as F

from keyframe.sources import nested
from keyframe.sources.checkpoint import Checkpoint
from keyframe.streaming import shared


def values(rng, deep=3):
    kind = rng.randrange(8 if deep else 5)
    if kind == 0:
        return rng.choice([None, True, False, 0, -1.5e300, 12345678901234567890])
    if kind < 5:
        return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "é", "\n", "日", "a", " ", "\\\\", '\\"']) for _ in range(rng.randrange(9)))
    if kind < 7:
        return [values(rng, deep - 1) for _ in range(rng.randrange(4))]
    return {str(values(rng, 0)): values(rng, deep - 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("split", [7, 100, 4 << 20])
def test_nested_brute(spark, tmp_path, split):
    rng = random.Random(3)
    whole = {f"o{k}": {f'{i} "{values(rng, 0)}"': values(rng) for i in range(20)} for k in range(3)} | {f"a{k}": [values(rng) for _ in range(15)] for k in range(3)} | {"empty": {}, "none": [], "bare": 7, "text": 'a "b", [c'}
    for i, (name, v) in enumerate(whole.items()):
        (tmp_path / f"{name}.json").write_text(json.dumps(v, indent=[None, 2, "\t"][i % 3], ensure_ascii=i % 2 == 0), encoding="utf-8")
    (tmp_path / "_marker").write_text("{")
    (tmp_path / "nothing.json").write_text("")
    got = nested.elements(spark, f"file://{tmp_path}", split).collect()
    for name, v in whole.items():
        own = sorted((r for r in got if r.path.endswith(f"/{name}.json")), key=lambda r: r.place)
        want = list(v.items()) if isinstance(v, dict) else [(None, x) for x in v] if isinstance(v, list) else []
        assert [(r.key, json.loads(r.value)) for r in own] == want, name
    assert len(got) == 3 * 20 + 3 * 15 and {r.path.rsplit("/", 1)[1].split(".")[0] for r in got} == {"o0", "o1", "o2", "a0", "a1", "a2"}


def test_nested_one_large_file(spark, tmp_path):
    """A file of some MB in one line, with an entry longer than a range, and backslashes over a border."""
    v = {f"k{i}": ["x" * (i % 50), {"n": i}] for i in range(30_000)} | {"long": "y\\" * 400_000, "end": [1]}
    (tmp_path / "f.json").write_text(json.dumps(v))
    got = nested.elements(spark, f"file://{tmp_path}/f.json", 65536)
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    assert {r.key: json.loads(r.value) for r in got.collect()} == v


def test_write_objects(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 60).alias("k"), F.to_json(F.struct("id")).alias("v"))
    nested.write_objects(rows.repartition(3), "k", "v", f"file://{tmp_path}/o")
    for f in (tmp_path / "o").glob("part-*"):
        json.loads(f.read_text())
    assert sorted((r.key, r.value) for r in nested.elements(spark, f"file://{tmp_path}/o", 50).collect()) == sorted((str(i % 60), f'{{"id":{i}}}') for i in range(100))


def test_checkpoint(spark, tmp_path):
    kept = Checkpoint(spark, f"file://{tmp_path}/c")
    rows = lambda n: spark.range(n).withColumn("b", F.lit(n))
    assert kept.read() is None and kept.batches() == {}
    assert kept.commit("a", rows(10)) and kept.commit("b", rows(5))
    assert not kept.commit("a", rows(10)) and kept.read().count() == 15
    again = Checkpoint(spark, f"file://{tmp_path}/c")  # another driver that repeats the run
    assert not again.commit("b", rows(5)) and again.commit("c", rows(2)) and again.read().count() == 17
    old = kept.read()
    kept.compact(2)
    assert kept.read().groupBy("b").count().collect() and kept.read().count() == old.count() == 17 and len(set(kept.batches().values())) == 1
    assert not kept.commit("c", rows(2)) and kept.clean() == 3 and kept.read().count() == 17


def test_checkpoint_breaks(spark, tmp_path, monkeypatch):
    """A batch whose rows are written, but whose manifest isn't, doesn't count; its repeat does."""
    kept = Checkpoint(spark, f"file://{tmp_path}/c")
    kept.commit("a", spark.range(3))
    monkeypatch.setattr(shared, "put", lambda *a: False)
    with pytest.raises(RuntimeError):
        kept.commit("b", spark.range(4))
    monkeypatch.undo()
    assert kept.read().count() == 3 and kept.commit("b", spark.range(4)) and kept.read().count() == 7 and kept.clean() == 1
