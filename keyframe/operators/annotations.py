"""Annotation sessions replayed from their events: what is pending, committed, undone and deleted.

An action is chosen first (select) and is pending until it has all that it needs: a box for most, a direction and a box for
SCROLL, two boxes for DRAG; a text that comes with the choice for TYPE and HOTKEY, without which the choice is dropped;
nothing for FINISH. Then it is committed. Another choice drops what is pending. Undo takes back the last commit that
hasn't been undone, by the place that the annotation had when it was committed; delete takes one away by its place and
isn't undone. So after a delete an undo may hit another annotation, or none."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: actions that need a text, a direction, two boxes, nothing
TEXT, DIRECTED, TWICE, BARE = {"TYPE", "HOTKEY"}, {"SCROLL"}, {"DRAG"}, {"FINISH"}
#: Fixed value: pixels under which a drag in both directions is no box.
LEAST_DRAG = 5
NOTES = "pos int, frame long, action string, text string, direction string"


class Session:
    """The state of one session; ``apply`` takes its events in order."""

    def __init__(self, state: str | None = None):
        self.pending, self.needs, self.notes, self.undo = json.loads(state) if state else (None, "", [], [])

    def state(self) -> str:
        return json.dumps([self.pending, self.needs, self.notes, self.undo])

    def _commit(self) -> None:
        self.undo.append(len(self.notes))
        self.notes.append(self.pending)
        self.pending, self.needs = None, ""

    def apply(self, op: str | None, frame, action, text, direction, width, height, place) -> None:
        if op == "select":
            self.pending, self.needs = [frame, action, None, None], "direction" if action in DIRECTED else "box"
            if action in TEXT:
                if text is None or action == "HOTKEY" and not text.strip():
                    self.pending, self.needs = None, ""
                else:
                    self.pending[2] = text.strip().lower() if action == "HOTKEY" else text
                    self._commit()
            elif action in BARE:
                self._commit()
        elif op == "direction" and self.needs == "direction" and direction:
            self.pending[3], self.needs = direction, "box"
        elif op == "box" and self.needs in ("box", "second") and (abs(width or 0) >= LEAST_DRAG or abs(height or 0) >= LEAST_DRAG):
            if self.needs == "box" and self.pending[1] in TWICE:
                self.needs = "second"
            else:
                self._commit()
        elif op == "cancel":
            self.pending, self.needs = None, ""
        elif op == "undo" and self.undo:
            at = self.undo.pop()
            if at < len(self.notes):
                self.notes.pop(at)
        elif op == "delete" and place is not None and 0 <= place < len(self.notes):
            self.notes.pop(place)


FIELDS = ["op", "frame", "action", "text", "direction", "width", "height", "place"]


def replay(events: DataFrame, session: str, at: str) -> DataFrame:
    """(session, pos, frame, action, text, direction): the annotations that stand at the end of each session, in order.

    ``events``: session, at, and the columns op (select, direction, box, cancel, undo, delete), frame, action, text, direction,
    width, height, place. Sessions are spread over tasks and pass through them in order of ``at``, a batch at a time; what is
    held is one session's annotations. Unknown and null ops do nothing; sessions without annotations give no rows."""
    kind = events.schema[session].dataType
    ordered = events.select(F.col(session).alias("session_"), F.col(at).alias("at_"), *FIELDS).repartition("session_").sortWithinPartitions("session_", "at_", *FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, now, started = None, Session(), False
        key = None

        def rows(of: Session):
            return [(i, *note) for i, note in enumerate(of.notes)]

        def made(found):
            types = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], key), *(pa.array([r[i] for _, r in found], t) for i, t in enumerate(types))], ["session_", "pos", "frame", "action", "text", "direction"])

        for batch in batches:
            key, out = batch.schema.field("session_").type, []
            for who, *event in zip(*(batch.column(c).to_pylist() for c in ("session_", *FIELDS))):
                if not started or who != name:
                    out += [(name, r) for r in rows(now)]
                    name, now, started = who, Session(), True
                now.apply(*event)
            if out:
                yield made(out)
        if now.notes:
            yield made([(name, r) for r in rows(now)])

    got = ordered.drop("at_").mapInArrow(run, f"session_ {kind.simpleString()}, {NOTES}")
    return got.withColumnRenamed("session_", session)


def replay_stream(events: DataFrame, session: str, at: str) -> DataFrame:
    """The same over a stream, in update mode: after each trigger (session, n, notes as JSON) of the sessions that had events.

    A session's state is its pending action, annotations and undo stack. Events of one trigger are put in order of ``at``;
    those of later triggers count as later."""
    kind = events.schema[session].dataType
    out = T.StructType([T.StructField(session, kind), T.StructField("n", T.IntegerType()), T.StructField("notes", T.StringType())])

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = Session(state.get[0] if state.exists else None)
        rows = [r for f in frames for r in f[[at, *FIELDS]].astype(object).where(f[[at, *FIELDS]].notna(), None).itertuples(index=False)]
        for _, *event in sorted(rows, key=lambda r: r[0]):
            event = [int(v) if isinstance(v, float) else v for v in event]
            now.apply(*event)
        state.update((now.state(),))
        yield pd.DataFrame({session: [key[0]], "n": [len(now.notes)], "notes": [json.dumps(now.notes)]})

    return events.groupBy(session).applyInPandasWithState(step, out, "state string", "update", "NoTimeout")
