"""Methods over questions: resuming, errors, and questions that share a video."""

import pytest
from pyspark.sql import functions as F

from keyframe.operators import select as C
from keyframe.plans import searches as Q
from keyframe.plans import surrogates as X

D = "/root/testdata/sf0.001"


def test_resumed(spark, tmp_path):
    items, clips = Q._items(spark, D)
    store = str(tmp_path / "answers")
    some = items.where("qid % 3 = 0")
    first = {r.qid: r.pred for r in Q.resumed(spark, some, clips, "capped", store).collect()}
    assert len(first) == some.count()
    full = Q.resumed(spark, items, clips, "capped", store, judge=lambda prompts: ["(E)"] * len(prompts)).collect()
    assert len(full) == len({r.qid for r in full}) == items.count()
    assert all(r.pred == first.get(r.qid, 4) for r in full)  # what was kept isn't asked again
    assert len(Q.resumed(spark, items, clips, "capped", store).collect()) == len(full)


def test_errors_and_hot_video(spark):
    rows = Q._clips(spark, D).limit(2).crossJoin(spark.range(50).withColumnRenamed("id", "qid"))

    def broken(clip, look):
        if look.question % 2:
            raise ValueError("no")
        return {"sample": [0], "reason": "ok"}

    got = C.choose(rows, "broken", "qid", methods={"broken": broken}).collect()
    assert len(got) == 100 and all((r.frames, r.reason) == (([], "error: ValueError") if r.qid % 2 else ([0], "ok")) for r in got)
    assert C.choose(rows.limit(0), "uniform", "qid").count() == 0


@pytest.mark.parametrize("method", ["capped", "guided", "agent", "cluster"])
def test_every_video_has_frames(spark, method):
    n = {r.video: r.n for r in X.frames(spark, D).groupBy("video").agg(F.count("*").alias("n")).collect()}
    rows = Q._search(method)(spark, D).groupBy("video").agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.count("*").alias("k"), F.countDistinct("frame").alias("u")).collect()
    assert {r.video for r in rows} == set(n) and all(0 <= r.a and r.b < n[r.video] and r.k == r.u <= 16 for r in rows)
