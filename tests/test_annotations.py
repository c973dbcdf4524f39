"""Replayed annotation sessions: rules by hand, and a stream against the batch."""

import json

from keyframe.operators import annotations as A
from keyframe.plans import timeline

SCHEMA = "s string, at int, op string, frame long, action string, text string, direction string, width int, height int, place int"


def ev(s, at, op, action=None, text=None, direction=None, width=9, height=0, place=None):
    return (s, at, op, 10 * at, action, text, direction, width, height, place)


def notes(spark, events):
    got = A.replay(spark.createDataFrame(events, SCHEMA), "s", "at").collect()
    out = {}
    for r in sorted(got, key=lambda r: r.pos):
        out.setdefault(r.s, []).append((r.frame, r.action, r.text, r.direction))
    return out


def test_rules(spark):
    events = [
        ev("a", 2, "box"), ev("a", 1, "select", "CLICK"), ev("a", 3, "box"),  # one box, one commit
        ev("b", 1, "select", "SCROLL"), ev("b", 2, "box"), ev("b", 3, "direction"), ev("b", 4, "direction", direction="up"), ev("b", 5, "box", width=4, height=-4), ev("b", 6, "box", width=0, height=-5),
        ev("c", 1, "select", "DRAG"), ev("c", 2, "box"), ev("c", 3, "select", "DRAG"), ev("c", 4, "box"), ev("c", 5, "box"),
        ev("d", 1, "select", "TYPE", ""), ev("d", 2, "select", "TYPE"), ev("d", 3, "select", "HOTKEY", "  "), ev("d", 4, "select", "HOTKEY", " Ctrl+S "), ev("d", 5, "select", "FINISH"), ev("d", 6, "select", "CLICK"), ev("d", 7, "cancel"), ev("d", 8, "box"),
        *(ev("e", k, "select", "FINISH") for k in range(1, 5)), ev("e", 5, "delete", place=1), ev("e", 6, "undo"), ev("e", 7, "undo"), ev("e", 8, "delete", place=9), ev("e", 9, None), ev("e", 10, "other"),
        ev("f", 1, "undo"), ev("f", 2, "select", "FINISH"), ev("f", 3, "undo"), ev("f", 4, "undo"), ev(None, 1, "select", "FINISH"),
    ]
    assert notes(spark, events) == {
        "a": [(10, "CLICK", None, None)],
        "b": [(10, "SCROLL", None, "up")],
        "c": [(30, "DRAG", None, None)],
        "d": [(10, "TYPE", "", None), (40, "HOTKEY", "ctrl+s", None), (50, "FINISH", None, None)],
        "e": [(10, "FINISH", None, None), (30, "FINISH", None, None)],  # the first undo finds no fourth any more
        None: [(10, "FINISH", None, None)],
    }
    assert notes(spark, []) == {}


def test_stream_like_batch(spark, tmp_path):
    events = timeline._annotating(spark, "/root/testdata/sf0.001").withColumnRenamed("video", "s")
    want = {}
    for r in sorted(A.replay(events, "s", "idx").collect(), key=lambda r: r.pos):
        want.setdefault(r.s, []).append([r.frame, r.action, r.text, r.direction])
    assert len(want) > 3
    n = 0
    for low, high in ((0, 20), (20, 21), (21, 10_000)):  # three arrivals
        n += 1
        part = events.where(f"idx >= {low} and idx < {high}").coalesce(1)
        part.write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(events.schema).json(str(tmp_path / "in"))

        def keep(df, number, n=n):
            df.write.mode("append").json(str(tmp_path / f"out-{n}"))

        q = A.replay_stream(stream, "s", "idx").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {}
    for k in range(1, n + 1):
        got |= {r.s: (r.n, json.loads(r.notes)) for r in spark.read.json(str(tmp_path / f"out-{k}")).collect()}
    assert {s: x[1] for s, x in got.items() if x[0]} == want
