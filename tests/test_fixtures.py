"""Hand-made cases for parsers, scores and timeline operators."""

import pytest
from pyspark.sql import functions as F

from keyframe.functions import actions as A
from keyframe.functions import answers as N
from keyframe.operators import search as S
from keyframe.operators import timeline as T
from keyframe.streaming import resume


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("reply,want", [("click( 0.5 , .25)", ("CLICK", 0.5, 0.25)), ("DOUBLE_CLICK(0.1,0.2)", ("CLICK", 0.1, 0.2)), ("CLICK(-0.1, 0.2)", ("UNKNOWN", None, None)), ("I cannot finish", ("FINISH", None, None)), ("", ("NULL", None, None)), (None, ("NULL", None, None))])
def test_parse(spark, reply, want):
    p = one(spark, A.parse_response(F.lit(reply).cast("string")))
    assert (p.type, p.x, p.y) == want and not p.error


def test_parse_texts(spark):
    assert one(spark, A.parse_response(F.lit("CLICK(1.2.3, 1)"))).error
    assert one(spark, A.parse_response(F.lit("TYPE(\"it's\")"))).text == "it's"
    assert one(spark, A.parse_response(F.lit("press('home')"))).key == "HOME"
    assert one(spark, A.text_similarity(F.lit("setting"), F.lit("Settings "))) == 0.875


@pytest.mark.parametrize("reply,truth,want", [("CLICK(0.60, 0.55)", "CLICK", 1.0), ("CLICK(0.70, 0.50)", "CLICK", 0.3), ("SCROLL(0.5,0.5,0.5,0.2)", "SCROLL", 0.65), ("SCROLL(0.5,0.2,0.5,0.8)", "SCROLL", 0.3), ('TYPE("abxy")', "TYPE", 0.3), ("FINISH()", "UNKNOWN", 0.0)])
def test_score(spark, reply, truth, want):
    at = {"CLICK": (0.5, 0.5, 0.5, 0.5), "SCROLL": (0.5, 0.8, 0.5, 0.2)}.get(truth, (0.0,) * 4)
    g = F.struct(F.lit(truth).alias("type"), *(F.lit(v).alias(c) for c, v in zip(("x", "y", "x2", "y2"), at)), F.lit("abcd").alias("text"), F.lit("BACK").alias("key"), F.lit("scroll down").alias("label"), F.lit(None).cast("array<struct<y:double,x:double,h:double,w:double>>").alias("boxes"))
    row = spark.createDataFrame([(reply,)], "r string").select(A.parse_response(F.col("r")).alias("p"), g.alias("g"))
    assert row.select(A.step_score(F.col("p"), F.col("g")).alias("s")).first().s == pytest.approx(want)


@pytest.mark.parametrize("reply,want", [("B", 1), ("(c) because", 2), ("The choice is D", 3), ("Answer: C", 0), ("Because", 1), ("I pick A or B", -1), (None, -1)])
def test_letter(spark, reply, want):
    assert one(spark, N.parse_letter(F.lit(reply).cast("string"))) == want


@pytest.mark.parametrize("mode,want", [("s", 2), ("r", -1), ("sr", 2), ("rs", 2), ("vote", 2), ("vote_conf_and", -1), ("vote_conf_or", 2)])
def test_combine(spark, mode, want):
    assert one(spark, N.combine(mode, *map(F.lit, (2, 3, 3, 2, 1, 3)))) == want


def test_lists(spark):
    assert one(spark, N.score_list(F.lit("[2, 1, 9]"), F.lit(3))) == [2, 1, 3]
    assert one(spark, N.score_list(F.lit("[2]"), F.lit(3))) == [2, 2, 2]
    assert one(spark, N.segment_id(F.lit("Segment 4"))) == 4
    assert tuple(one(spark, N.duration(F.lit("7")))) == (7, 7)


def test_samples(spark):
    assert one(spark, T.linspace(F.lit(100), 16)) == [0, 6, 13, 19, 26, 33, 39, 46, 52, 59, 66, 72, 79, 85, 92, 99]
    assert one(spark, T.rounded(F.lit(12), 10)) == [0, 1, 2, 4, 5, 6, 7, 9, 10, 11]
    assert one(spark, T.clock(F.lit(125), 25)) == "00:05:00"


def test_coverage(spark):
    f = spark.createDataFrame([(1, x) for x in (0, 10, 20, 100)] + [(2, x) for x in (0, 1, 2, 3, 4, 5, 105)], "video int, idx int")
    got = {r.video: r for r in T.coverage(f, "video", "idx").collect()}
    assert (got[1].max_gap, got[1].imbalanced, got[1].n_sparse) == (80, False, 1) and got[2].imbalanced


@pytest.mark.parametrize("mode,want", [("retain", {(1, 11), (11, 16), (16, 21)}), ("prune", {(11, 16), (16, 21)})])
def test_split(spark, mode, want):
    s = spark.createDataFrame([(1, 1, 11, False), (1, 11, 21, True)], "video int, start int, end int, chosen boolean")
    assert {(r.start, r.end) for r in T.split(s, "chosen", mode).collect()} == want


def test_search_bounds(spark):
    f = spark.range(100).selectExpr("1L as video", "cast(id as int) as idx", "(id * 37) % 101 as v")
    for name in S.STRATEGIES:
        got = S.tree_search(f, name).first()
        assert got.frames == sorted(set(got.frames)) and set(range(0, 100, 20)) <= set(got.frames) and got.n_frames == len(got.frames) and -1 <= got.answer <= 4


def test_stream_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    work = lambda df: df.withColumn("done", F.lit(True))
    spark.createDataFrame([(1,), (2,)], "id long").write.json(src)
    resume.run_available(spark, src, "id long", work, out, ck)
    spark.createDataFrame([(3,)], "id long").write.mode("append").json(src)
    resume.run_available(spark, src, "id long", work, out, ck)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
