"""Conversation structure repair by signature deduplication.

A conversation's rows, in order of turn, are coded as one letter each: the role's initial, in upper case if the text is
truncated, or x if the row must go (blank, or role and text seen earlier). This string is the conversation's signature.
Each distinct signature is solved once, by a memoised recursion over (place, state of the grammar ``(s?(ua)+)?``); the
script found is joined back to all conversations that have the signature, and replayed on their rows.

Costs: a row kept 0, given the role user or assistant 3, deleted 4, an empty row inserted 3; a truncated row that isn't
deleted 3 more. Of the cheapest edits those whose initials (K, R, D, I) are least in ASCII win.

Rows of equal turn go by role, then by a hash of role and text, so that repeated rows are adjacent. Null roles and texts
count as one space; null turns come first; null ids are a conversation like another; an empty table gives no rows.

A conversation takes one byte a row where it is solved and passes through one task in order when it is replayed, a batch
at a time, as a hash of its text can only be taken in order; nothing else holds a conversation whole.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._scratch import FEW, Scratch

#: States: nothing yet, after a system row, after a user row, after an assistant row. Where a kept row leads, and where
#: the next user or assistant does, whether inserted or renamed.
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_NEXT = (2, 2, 3, 2)
_FAR = 1 << 40
#: Places by which the recursion starts before the end each time, so that it never goes deeper.
_STRIDE = 200
WHITE = " \t\n\x0b\x0c\r"
CHUNK = 4096


def solve(signature: str) -> tuple[int, str]:
    """(cost, script) of the cheapest edits. A script has a letter for each edit: K, D; U or A for a row made user or
    assistant; u or a for such a row inserted."""
    n = len(signature)
    memo = array("q", [-1]) * (4 * (n + 1))

    def acts(i: int, state: int):
        code = signature[i]
        if code != "x":
            more = 3 if code.isupper() else 0
            if (to := _KEEP.get((state, code.lower()))) is not None:
                yield "K", more, to
            yield "R", 3 + more, _NEXT[state]
        yield "D", 4, state

    def go(i: int, state: int) -> int:
        """The least cost without an insertion before row i."""
        if i == n:
            return 0 if state in (0, 3) else _FAR
        return min(cost + rest(i + 1, to) for _, cost, to in acts(i, state))

    def rest(i: int, state: int) -> int:
        at = 4 * i + state
        if memo[at] < 0:
            one = _NEXT[state]
            memo[at] = min(go(i, state), 3 + go(i, one), 6 + go(i, _NEXT[one]) if state < 2 else _FAR)
        return memo[at]

    for i in range(n, -1, -_STRIDE):
        for state in range(4):
            rest(i, state)
    i, state, script = 0, 0, []
    while i < n or state not in (0, 3):
        left = rest(i, state)
        options = [("I", 3, i, _NEXT[state])]
        if i < n:
            options += [(letter, cost, i + 1, to) for letter, cost, to in acts(i, state)]
        letter, _, i, to = min(o for o in options if o[1] + rest(o[2], o[3]) == left)
        role = "u" if to == 2 else "a"
        script.append({"I": role, "R": role.upper()}.get(letter, letter))
        state = to
    return rest(0, 0), "".join(script)


def audit(script: Column) -> Column:
    """The initials of a script's edits."""
    return F.translate(script, "uaUA", "IIRR")


def _shaped(turns: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"), F.lit(False).alias("lost"))


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20: 0 loses a
    row, 1 empties its text, 2 takes its . ! ? away, 3 repeats it, 4 makes it a user's. Rows that are lost stay, marked in
    ``lost``, as their conversation stays."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    out = _shaped(turns).withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _marks() -> list[Column]:
    return [F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit(1), "role", "text").alias("d2")]


def _facts(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature). Texts leave their task as flags and a hash."""
    kept = F.rtrim(F.col("text"), F.lit(WHITE))
    first = F.substring("role", 1, 1)
    own = rows.select("conv_id", "turn", "role", "lost", *_marks(), F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("initial"), (kept == "").alias("blank"), (~F.right(kept, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    own = own.repartition("conv_id")
    same = Window.partitionBy("conv_id", "lost", "role", "d1", "d2").orderBy(F.col("turn").asc_nulls_first())
    order = Window.partitionBy("conv_id").orderBy("lost", F.col("turn").asc_nulls_first(), "role", "d1", "d2", "again")
    own = own.withColumn("again", F.row_number().over(same) > 1)
    own = own.withColumns({"pos": F.row_number().over(order), "last": F.lag("initial").over(order), "last_turn": F.lag("turn").over(order)}).withColumn("there", ~F.col("lost"))
    there = F.col("there")
    duplicate = there & ~F.col("blank") & F.col("again")
    truncated = there & ~F.col("blank") & ~F.col("again") & F.col("truncated")
    code = F.when(F.col("blank") | F.col("again"), "x").when(F.col("truncated"), F.upper("initial")).otherwise(F.col("initial"))
    fresh = there & F.col("turn").isNotNull() & (F.col("last_turn").isNull() | (F.col("last_turn") != F.col("turn")))
    bad = there & F.col("last").isNotNull() & ~F.concat("last", "initial").isin("su", "ua", "au")
    counts = {"blank": there & F.col("blank"), "duplicate": duplicate, "truncated": truncated, "illegal": bad, "turns": fresh}
    parts = own.groupBy("conv_id", ((F.col("pos") - 1) / CHUNK).cast("int").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.when(there, F.struct("pos", code.alias("code"))))).alias("codes"),
        F.min(F.when(there, F.col("turn"))).alias("low"),
        F.max(F.when(there, F.col("turn"))).alias("high"),
        *(F.sum(c.cast("long")).alias(f"n_{k}") for k, c in counts.items()),
    )
    parts = parts.withColumn("codes", F.array_join(F.transform("codes", lambda c: c.code), ""))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "codes"))).alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"), *(F.sum(f"n_{k}").alias(k) for k in counts))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    gaps = F.when(F.col("high").isNotNull(), F.least(wide("high") - wide("low") + 1 - F.col("turns"), F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long"))
    return whole.select("conv_id", F.coalesce(gaps, F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.array_join(F.transform("parts", lambda p: p.codes), "").alias("signature"))


def _solve_map(batches):
    for batch in batches:
        names = batch.column("signature").to_pylist()
        for a in range(0, len(names), 1000):
            found = [solve(s) for s in names[a : a + 1000]]
            yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 1000]), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], ["signature", "cost", "script"])


def _plans(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """The facts of each conversation with cost and script, written."""
    facts = scratch.cut(_facts(rows))
    solved = scratch.cut(facts.select("signature").distinct().mapInArrow(_solve_map, "signature string, cost long, script string"))
    n, size = solved.agg(F.count("*"), F.sum(F.length("signature") + F.length("script"))).first()
    few = n <= FEW and (size or 0) <= 32 << 20  # else a shuffled join, whose hot signatures Spark splits
    return scratch.cut(facts.join(F.broadcast(solved) if few else solved, "signature").drop("signature"))


EDITS = {"K": "keep", "D": "delete", "U": "rerole", "A": "rerole", "u": "insert", "a": "insert"}


def _replay_map(key: pa.DataType):
    names = ["conv_id", "place", "edit", "turn", "role", "text"]

    def run(batches):
        conv, script, at, place, out = None, "", 0, 0, []

        def inserts():
            nonlocal at, place
            while at < len(script) and script[at] in "ua":
                out.append((conv, place, "insert", None, "user" if script[at] == "u" else "assistant", ""))
                at, place = at + 1, place + 1

        def made():
            kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            done = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
            out.clear()
            return done

        for batch in batches:
            for c, s, turn, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "script", "turn", "role", "text"))):
                if s is not None:  # stands before its conversation's rows
                    inserts()
                    conv, script, at, place = c, s, 0, 0
                    continue
                inserts()
                letter, at = script[at], at + 1
                if letter != "D":
                    out.append((conv, place, EDITS[letter], turn, {"U": "user", "A": "assistant"}.get(letter, role), text))
                    place += 1
            if out:
                yield made()
        inserts()
        if out:
            yield made()

    return run


def _replayed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired rows; within a partition each conversation's stand together and in order."""
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    heads = plans.select("conv_id", "script", *(none(c) for c in ("turn", "role", "text")), *(F.lit(None).cast("long").alias(c) for c in ("d1", "d2")))
    body = rows.where("not lost").select("conv_id", F.lit(None).cast("string").alias("script"), "turn", "role", "text", *_marks())
    both = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", F.col("script").isNull(), F.col("turn").asc_nulls_first(), "role", "d1", "d2")
    kind = rows.schema["conv_id"].dataType
    return both.select("conv_id", "script", "turn", "role", "text").mapInArrow(_replay_map(_arrow(kind)), f"conv_id {kind.simpleString()}, place long, edit string, turn long, role string, text string")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def repair(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, rows) of ``turns`` (conv_id, turn, role, text; other columns don't matter).

    Plans: a row for each conversation with gaps, blank, duplicate, truncated, illegal, cost and script. Rows: the
    repaired conversations, (conv_id, place from 0, edit, turn, role, text); inserted rows have no turn."""
    rows = _shaped(turns)
    plans = _plans(Scratch(spark, "conversations"), rows)
    return plans, _replayed(rows, plans)


def _digest_map(key: pa.DataType):
    def run(batches):
        conv, digest = None, None
        for batch in batches:
            done = []
            for c, place, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if digest:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(role.encode() + b":")
                digest.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], key), pa.array([d[1] for d in done])], ["conv_id", "digest"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([conv], key), pa.array([digest.hexdigest()])], ["conv_id", "digest"])

    return run


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, digest) of repaired rows as ``repair`` returns them: SHA-256 of ``role:text`` joined by newlines."""
    kind = rows.schema["conv_id"].dataType
    return rows.select("conv_id", "place", "role", "text").mapInArrow(_digest_map(_arrow(kind)), f"conv_id {kind.simpleString()}, digest string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    plans = _plans(Scratch(spark, "conversations"), rows)
    found = digests(_replayed(rows, plans)).withColumnRenamed("conv_id", "id")
    out = plans.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit(F.col("script")).alias("audit"), F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: CRC-32 by its table, over the bytes of the key; the edits by dynamic programming from the first row on.
SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) AS r(i))
), keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), hashed AS (
    SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % 20 AS kind
    FROM keyed, crc
), turns AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, kind = 0 AS lost
    FROM hashed, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)
), facts AS (
    SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS kept,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again
    FROM turns WHERE NOT lost
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS pos FROM facts
), faults AS (
    SELECT *, CASE WHEN kept = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS last FROM placed
), moves(state, ins, more, to_state) AS (
    VALUES (0, '', 0, 0), (0, 'I', 3, 2), (0, 'II', 6, 3), (1, '', 0, 1), (1, 'I', 3, 2), (1, 'II', 6, 3), (2, '', 0, 2), (2, 'I', 3, 3), (3, '', 0, 3), (3, 'I', 3, 2)
), acts(state, initial, act, cost, to_state, role) AS (
    VALUES (0, 's', 'K', 0, 1, NULL), (0, 'u', 'K', 0, 2, NULL), (1, 'u', 'K', 0, 2, NULL), (2, 'a', 'K', 0, 3, NULL), (3, 'u', 'K', 0, 2, NULL),
        (0, NULL, 'R', 3, 2, 'user'), (1, NULL, 'R', 3, 2, 'user'), (2, NULL, 'R', 3, 3, 'assistant'), (3, NULL, 'R', 3, 2, 'user'),
        (0, NULL, 'D', 4, 0, NULL), (1, NULL, 'D', 4, 1, NULL), (2, NULL, 'D', 4, 2, NULL), (3, NULL, 'D', 4, 3, NULL)
), fills(state, ins, rows) AS (
    VALUES (0, '', ''), (1, '', ''), (2, '', ''), (3, '', ''), (0, 'I', chr(10) || 'user:'), (1, 'I', chr(10) || 'user:'), (2, 'I', chr(10) || 'assistant:'), (3, 'I', chr(10) || 'user:'),
        (0, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), walk AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, {'c': CAST(0 AS BIGINT), 'a': '', 'r': ''} AS best FROM conversations GROUP BY conv_id
    UNION ALL
    SELECT w.conv_id, w.pos + 1, a.to_state, min({'c': w.best.c + m.more + a.cost + CASE WHEN f.fault = 'truncated' AND a.act <> 'D' THEN 3 ELSE 0 END, 'a': w.best.a || m.ins || a.act,
        'r': w.best.r || i.rows || CASE WHEN a.act = 'D' THEN '' ELSE chr(10) || coalesce(a.role, f.role) || ':' || f.text END})
    FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1 JOIN moves m ON m.state = w.state JOIN fills i ON i.state = m.state AND i.ins = m.ins
    JOIN acts a ON a.state = m.to_state AND (a.act = 'D' OR f.fault IS DISTINCT FROM 'blank' AND f.fault IS DISTINCT FROM 'duplicate') AND (a.initial IS NULL OR a.initial = f.initial)
    GROUP BY w.conv_id, w.pos, a.to_state
), ends AS (
    SELECT w.conv_id, min({'c': w.best.c + m.more, 'a': w.best.a || m.ins, 'r': w.best.r || i.rows}) AS best
    FROM walk w JOIN (SELECT conv_id, max(pos) AS n FROM walk GROUP BY conv_id) e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.n = w.pos
    JOIN moves m ON m.state = w.state AND m.to_state IN (0, 3) JOIN fills i ON i.state = m.state AND i.ins = m.ins GROUP BY w.conv_id
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (last IS NOT NULL AND last || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    e.best.c AS cost, e.best.a AS audit, sha256(substr(e.best.r, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
