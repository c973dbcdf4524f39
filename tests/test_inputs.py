"""Every reader and writer on files, and judges."""

import json
import os

import pytest
from pyspark.sql import functions as F

from keyframe.functions import answers as N
from keyframe.operators import boards as B
from keyframe.operators import judge as J
from keyframe.operators import timeline as T
from keyframe.sources import readers as R
from keyframe.sources import sinks as K

CLASSES = {"CLICK": (730, 0.746, 0.88), "SCROLL": (130, 0.3015, 0.4), "TYPE": (120, 0.285, 0.6), "PRESS": (20, 0.2857, 0.3), "ZOOM": (12, 0.0833, 0.0833), "FINISH": (0, 0.0, 0.0)}
# fixed values: the line forms that a log is read by; what stands around them doesn't matter
LOG = "\n".join([
    "a log", "Total Steps | 1019", "Overall Score | 0.6100", "Overall Type Acc | 0.7625",
    *(f"{c} | {n} | {a:.4f} | {t:.4f}" for c, (n, a, t) in CLASSES.items()),
    "[Overall Avg Score]: 0.6168", "Avg Episode Completion : 0.7861 (136 episodes)", "Avg Images Per Step : 10.88 (1019 steps)", "",
])


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def text_of(spark, value):
    return spark.createDataFrame([(json.dumps(value),)], "text string")


def test_log(spark, tmp_path):
    root = str(tmp_path)
    write(f"{root}/model-a_uniform10/run.log", LOG)
    write(f"{root}/model-a_single/run.log", "[Overall Avg Score]: 0.5000\n")
    write(f"{root}/model-b_single/run.log", "nothing")
    write(f"{root}/other/run.log", LOG)
    rows = {(r.model, r.mode): r for r in R.run_logs(spark, root).collect()}
    assert set(rows) == {("model-a", "uniform10"), ("model-a", "single")}
    a = rows["model-a", "uniform10"]
    assert (a.acc, a.type_acc, a.completion, a.images, a.total_steps) == (0.6168, 0.7625, 0.7861, 10.88, 1019)
    assert (a.click_count, a.click_score, a.click_type_acc) == (730, 0.746, 0.88) and (a.finish_count, a.zoom_score, a.type_score) == (0, 0.0833, 0.285)
    assert rows["model-a", "single"].total_steps is None
    lines = [r.line for r in B.markdown(R.run_logs(spark, root)).orderBy("number").collect()]
    assert "| model-a | 61.68 | 76.25 | 74.60 | 30.15 | 28.50 | 28.57 | 8.33 | 0.00 | 78.61 | 10.88 | 0.234 |" in lines
    assert "| model-a | No Video | 50.00 | 0.00 | 0.00 | 0.00 | 0.00 | 0.00 | 0.00 | 0.00 | 0.00 | 0 | — |" in lines
    assert [x for x in lines if x.startswith("#")] == ["# Leaderboard", "## No Video Input", "## With Video Input", "## Combined"]
    table = B.table(R.run_logs(spark, root))
    assert [(r.Mode, r.Acc, r.PIR, r.Total_Steps) for r in table.orderBy("number").collect()] == [("No Video", "0.5000", "", ""), ("Uniform10", "0.6168", "0.2336", "1019")]
    K.board_csv(table, f"{root}/csv")
    K.lines(B.markdown(R.run_logs(spark, root)), f"{root}/md")
    assert spark.read.option("header", "true").csv(f"{root}/csv").count() == 2
    assert [r.value for r in spark.read.text(f"{root}/md").collect()] == lines


def test_summary_log_reads_back(spark):
    best = spark.createDataFrame([("CLICK", True, 1.0), ("CLICK", False, 0.0), ("TYPE", True, 0.3)], "gt_type string, type_ok boolean, score double")
    at = lambda t: F.to_timestamp(F.lit(t))
    rows = B.summary_log(best, at("2024-01-01 00:00:00"), at("2024-01-01 01:02:03")).orderBy("number").collect()
    text = "\n".join(r.line for r in rows)
    got = spark.createDataFrame([(text,)], "t string").select(*R.log_metrics(F.col("t"))).first()
    assert (got.acc, got.type_acc, got.total_steps, got.click_count, got.click_score, got.type_type_acc, got.zoom_count) == (0.4333, 0.6667, 3, 2, 0.5, 1.0, 0)
    assert "1:02:03" in text


def test_results_tree(spark, tmp_path):
    root = str(tmp_path)
    write(f"{root}/m1/d1/results.json", {"accuracy_pct": "61.00%", "avg_frames": 16})
    write(f"{root}/m2/d1/results.json", "{broken")
    write(f"{root}/m1_checkpoint/d1/results.json", {"accuracy_pct": "1"})
    rows = R.named(R.run_results(spark, root), {"m1": "Method one"})
    got = {r.method: (r.display, r.dataset, r.accuracy, r.avg_frames, r.error) for r in rows.collect()}
    assert got == {"m1": ("Method one", "d1", "61.00%", 16.0, False), "m2": ("m2", "d1", None, None, True)}
    lines = [r.line for r in B.console(rows, 12).orderBy("number").collect()]
    assert lines == ["  Method one   d1                   61.00%       16.0      ", "  [WARN] m2/d1"]


def test_questions_csv_and_parquet(spark, tmp_path):
    head = "video,frame_count,width,height,question,answer,qid,type,a0,a1,a2,a3,a4\n"
    path = write(f"{tmp_path}/deep/er/q.csv", head + "v1,10,1,1,why?,2,7,CW,a,b,c,d,e\n")
    got = R.question_table(spark, str(tmp_path)).first()
    assert (got.qid, got.video_id, got.options, got.answer, got.q_type) == ("v1_7", "v1", list("abcde"), 2, "CW")
    spark.read.option("header", "true").schema("video string, frame_count int, width int, height int, question string, answer int, qid string, type string, a0 string, a1 string, a2 string, a3 string, a4 string").csv(path).write.parquet(f"{tmp_path}/pq/x")
    assert R.question_table(spark, f"{tmp_path}/pq", "parquet").first().qid == "v1_7"


def test_captions_manifest_narration(spark):
    c = R.captions(text_of(spark, {"v": ["one", "two"]})).collect()
    assert [tuple(r) for r in c] == [("v", 1, "one"), ("v", 2, "two")]
    m = R.manifest(text_of(spark, {"web": [{"path": "p", "task": "t"}]})).first()
    assert (m.domain, m.path, m.task, m.title) == ("web", "p", "t", None)
    a = spark.createDataFrame([("v", 1), ("w", 2)], "video_id string, q int")
    n = spark.createDataFrame([("v", ["x", "y", "z"])], "video_id string, c array<string>").select("video_id", R.narration(F.col("c"), 2).alias("narration"))
    d = spark.createDataFrame([("v", 180.0)], "video_id string, duration double")
    assert [tuple(r) for r in R.narrated(a, n, d).select("q", "narration", "duration").collect()] == [(1, "0: x.\n2: z", 180)]
    with pytest.raises(Exception, match="no duration"):
        R.narrated(a, n, d.limit(0)).collect()


def test_files(spark, tmp_path):
    for name in ("v/b.png", "v/a.jpg", "w/c.txt", "m.mp4"):
        write(f"{tmp_path}/{name}", "x")
    assert [(r.video_id, r.name) for r in R.images(spark, str(tmp_path)).collect()] == [("v", "a.jpg"), ("v", "b.png")]
    assert [r.video_id for r in R.local_videos(spark, str(tmp_path)).collect()] == ["m"]
    assert R.first_existing(spark, f"{tmp_path}/none", f"{tmp_path}/v") == f"{tmp_path}/v" and R.first_existing(spark, f"{tmp_path}/none") is None
    assert R.example_text(spark, write(f"{tmp_path}/e/example.txt", "two\nlines")) == "two\nlines"
    row = spark.createDataFrame([("a.PNG", b"xy"), ("b.bin", b"")], "n string, b binary").select(R.data_url(F.col("n"), F.col("b")).alias("u")).collect()
    assert [r.u for r in row] == ["data:image/png;base64,eHk=", "data:image/jpeg;base64,"]
    for s in ("train", "test"):
        spark.createDataFrame([(s, 1)], "a string, b int").write.parquet(f"{tmp_path}/hub/{s}")
    assert {tuple(r) for r in R.splits(spark, f"{tmp_path}/hub").select("a", "split").collect()} == {("train", "train"), ("test", "test")}


def test_sinks(spark, tmp_path):
    d = str(tmp_path)
    t = spark.createDataFrame([("m", "d", 1, -1, 3), ("m", "e", 2, 4, 4)], "method string, dataset string, qid int, answer int, shard int")
    K.predictions(t, f"{d}/p")
    assert spark.read.json(f"{d}/p").count() == 2
    K.results(t, f"{d}/r")
    assert os.path.isdir(f"{d}/r/method=m/dataset=e")
    K.frame_records(t, f"{d}/f")
    assert os.path.isdir(f"{d}/f/shard=3")
    K.board_json(t, f"{d}/b")
    assert json.loads(spark.read.text(f"{d}/b").orderBy("value").first().value)["qid"] == 1
    for _ in range(2):
        K.append_batch(t, f"{d}/a")
    assert spark.read.parquet(f"{d}/a").count() == 4
    K.submission(t, f"{d}/s")
    assert sorted(r.value for r in spark.read.text(f"{d}/s").collect()) == ['{"id":"1","answer":0}', '{"id":"2","answer":4}']
    long = spark.createDataFrame([("t", "b", 1.0), ("t", "a", 2.0), ("u", "a", 3.0)], "task string, metric string, value double")
    K.metrics_csv(long, f"{d}/m", ["b", "a"])
    got = spark.read.option("header", "true").csv(f"{d}/m").orderBy("task").collect()
    assert got[0].__fields__ == ["task", "a", "b"] and (got[0].a, got[1].b) == ("2.0", None)
    steps = spark.createDataFrame([("v", "t", "x", 2, "b"), ("v", "t", "x", 1, "a")], "video_id string, task string, title string, step int, action string")
    K.annotations(steps, f"{d}/n")
    assert spark.read.json(f"{d}/n").first().steps == ["a", "b"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("reply,want", [('x ```json\n{"a": {"b": 1}}\n``` y', '{"a": {"b": 1}}'), ('{"a": {"b": 1}}', '{"a": {"b": 1}}'), ("so {'a': 1} or [2]", '{"a": 1}'), ("no {b} but [1, 2]", "[1, 2]"), ("nothing", None), (None, None)])
def test_json_text(spark, reply, want):
    assert one(spark, N.json_text(F.lit(reply).cast("string"))) == want


def test_replies(spark):
    assert one(spark, N.segment_id(F.lit("12-40"))) == 12 and one(spark, N.segment_id(F.lit("no -3"))) == 3
    assert one(spark, N.field_any_case(N.unwrapped(F.lit('[{"Segment_ID": 4}, 1]')), "segment_id")) == "4"
    assert one(spark, N.unwrapped(F.lit("[1]"))) is None and one(spark, N.sole_value(F.lit('{"a": "2"}'))) == "2"
    assert one(spark, N.sole_value(F.lit('{"a": "2", "b": 1}'))) is None
    assert one(spark, N.hms(F.lit(3725.5))) == "01:02:05.500" and one(spark, N.minutes(F.lit(1830), F.lit(30))) == "1:01"


def test_judges(spark, tmp_path, monkeypatch):
    waits = []
    monkeypatch.setattr(J.time, "sleep", waits.append)
    assert J.with_retry(lambda p: 1 / 0, 3, 2.0)(["a", "b"]) == ["", ""] and waits == [2.0, 4.0]
    seen = []
    judge = J.until_read(lambda p: [seen.append(x) or ("ok" if seen.count(x) > 1 or x == "a" else "?") for x in p], lambda r: r == "ok")
    assert judge(["a", "b"]) == ["ok", "ok"] and seen == ["a", "b", "b"]
    made = []
    ask = J.per_worker("t", lambda: made.append(1) or (lambda p: p))
    assert ask(["x"]) == ["x"] and ask(["y"]) == ["y"] and made == [1]
    assert one(spark, J.prompt_of("summary", narration=F.lit("a. b"))) == "Sum up what these captions show: a. b"
    calls = f"{tmp_path}/calls"

    def noted(prompts):
        with open(calls, "a") as f:
            f.writelines(p + "\n" for p in prompts)
        return ["B"] * len(prompts)

    rows = spark.createDataFrame([("p1",), ("p1",), ("p2",)], "prompt string")
    cache = spark.createDataFrame([], "key string, reply string")
    full, new = J.cached(rows, cache, noted, store=f"{tmp_path}/new")
    assert full.count() == 3 and new.count() == 2 and {r.reply for r in full.collect()} == {"B"}
    assert sorted(open(calls).read().split()) == ["p1", "p2"]  # each prompt once, for both results


def test_positions(spark):
    ids = [(i * 37) % 1009 for i in range(500)]
    got = {r.i: r.pos for r in T.positions(spark.createDataFrame([(i,) for i in ids], "i int").repartition(4), "i", 8).collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}
    assert T.positions(spark.createDataFrame([], "i int"), "i").count() == 0


def test_overriding(spark):
    t = lambda *a: spark.createDataFrame([(x,) for x in a], "id int")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(T.overriding(t(1, 2, 3), only=[2, 9])) == [2]
    assert ids(T.overriding(t(1, 2, 3), only=[2], rerun=t(5, 6), avoid=[6])) == [5]
    assert ids(T.overriding(t(1, 2), rerun=t(5), listed=t(7))) == [7]
