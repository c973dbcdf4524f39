"""The engine's domain tables made from the supplied test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Interface steps from lineitem: an episode per order, typed actions in hundredths of the screen, and a reply."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    s = li.select(F.col("l_orderkey").alias("ep"), F.row_number().over(w).alias("step"), (2 * F.col("l_quantity")).cast("int").alias("xi"), (9 * F.round(100 * F.col("l_discount"))).cast("int").alias("yi"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"))
    p4 = F.col("pk") % 4
    s = s.withColumn("type_id", F.when(F.col("rf") == "A", 4).when(F.col("rf") == "N", F.when(F.col("pk") % 3 == 0, 3).otherwise(4)).when(p4 == 0, 3).when(p4 == 1, (5 + F.col("sk") % 3).cast("int")).when(p4 == 2, 12).otherwise(10))
    s = s.withColumn("label", F.when((F.col("type_id") == 4) & (F.col("rf") == "N"), F.element_at(F.array(*map(F.lit, ("scroll up", "scroll down", "scroll left", "scroll right"))), (F.col("sk") % 4 + 1).cast("int"))).otherwise("click"))
    move = F.col("label") != "click"
    s = s.withColumn("x2i", F.when(move, (F.col("xi") + 30) % 100).otherwise(F.col("xi"))).withColumn("y2i", F.when(move, (F.col("yi") + 10 * (F.col("pk") % 7).cast("int")) % 100).otherwise(F.col("yi")))
    s = s.withColumn("type_text", F.concat(F.lit("Word"), (F.col("pk") % 50).cast("string"))).withColumn("pxi", ((F.col("xi") + F.col("sk") % 17) % 100).cast("int"))
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    dot = lambda c: F.concat(F.lit("0."), two(c))
    reply = (
        F.when(F.col("pk") % 19 == 0, "").when(F.col("pk") % 23 == 0, "CLICK(1.2.3, 1)").when(F.col("pk") % 29 == 0, "I cannot finish").when(F.col("pk") % 31 == 0, "CLICK(-0.1, 0.2)")
        .when(F.col("type_id") == 3, F.concat(F.lit("TYPE('word"), ((F.col("pk") + F.col("sk") % 2) % 50).cast("string"), F.lit(" ')")))
        .when(F.col("type_id").isin(5, 6, 7), F.concat(F.lit('press("'), F.element_at(F.array(F.lit("back"), F.lit("home"), F.lit("enter")), (F.col("pk") % 3 + 1).cast("int")), F.lit('")')))
        .when(F.col("type_id") == 12, "Zoom in").when(F.col("type_id") == 10, "Finish()")
        .when(F.col("label") == "click", F.concat(F.lit("click( "), dot("pxi"), F.lit(" , "), dot("yi"), F.lit(")")))
        .otherwise(F.concat(F.lit("SCROLL("), F.concat_ws(", ", dot("pxi"), dot("yi"), dot("x2i"), dot("y2i")), F.lit(")")))
    )
    return s.withColumn("reply", reply)


STEPS = r"""
b0 AS (SELECT l_orderkey AS ep, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS step,
  CAST(2 * l_quantity AS INT) AS xi, CAST(9 * round(100 * l_discount) AS INT) AS yi, l_partkey AS pk, l_suppkey AS sk, l_returnflag AS rf, l_linestatus AS ls FROM lineitem),
b1 AS (SELECT *, CAST(CASE WHEN rf = 'A' THEN 4 WHEN rf = 'N' THEN CASE WHEN pk % 3 = 0 THEN 3 ELSE 4 END WHEN pk % 4 = 0 THEN 3 WHEN pk % 4 = 1 THEN 5 + sk % 3 WHEN pk % 4 = 2 THEN 12 ELSE 10 END AS INT) AS type_id FROM b0),
b2 AS (SELECT *, CASE WHEN type_id = 4 AND rf = 'N' THEN (['scroll up', 'scroll down', 'scroll left', 'scroll right'])[CAST(sk % 4 + 1 AS INT)] ELSE 'click' END AS label FROM b1),
b3 AS (SELECT *, CASE WHEN label <> 'click' THEN (xi + 30) % 100 ELSE xi END AS x2i, CASE WHEN label <> 'click' THEN CAST((yi + 10 * (pk % 7)) % 100 AS INT) ELSE yi END AS y2i,
  'Word' || (pk % 50) AS type_text, CAST((xi + sk % 17) % 100 AS INT) AS pxi FROM b2),
steps AS (SELECT *, CASE WHEN pk % 19 = 0 THEN '' WHEN pk % 23 = 0 THEN 'CLICK(1.2.3, 1)' WHEN pk % 29 = 0 THEN 'I cannot finish' WHEN pk % 31 = 0 THEN 'CLICK(-0.1, 0.2)'
  WHEN type_id = 3 THEN 'TYPE(''word' || ((pk + sk % 2) % 50) || ' '')' WHEN type_id IN (5, 6, 7) THEN 'press("' || (['back', 'home', 'enter'])[CAST(pk % 3 + 1 AS INT)] || '")'
  WHEN type_id = 12 THEN 'Zoom in' WHEN type_id = 10 THEN 'Finish()'
  WHEN label = 'click' THEN 'click( 0.' || lpad(CAST(pxi AS VARCHAR), 2, '0') || ' , 0.' || lpad(CAST(yi AS VARCHAR), 2, '0') || ')'
  ELSE 'SCROLL(0.' || lpad(CAST(pxi AS VARCHAR), 2, '0') || ', 0.' || lpad(CAST(yi AS VARCHAR), 2, '0') || ', 0.' || lpad(CAST(x2i AS VARCHAR), 2, '0') || ', 0.' || lpad(CAST(y2i AS VARCHAR), 2, '0') || ')' END AS reply FROM b3)
"""

# fixed values: the grammar of replies, as in functions/actions.py
PARSED = r"""
p0 AS (SELECT *, regexp_extract(reply, 'CLICK\s*\(\s*([\d\.]+)\s*,\s*([\d\.]+)\s*\)', ['a', 'b'], 'i') AS c,
  regexp_extract(reply, 'SCROLL\s*\(\s*([\d\.]+)\s*,\s*([\d\.]+)\s*,\s*([\d\.]+)\s*,\s*([\d\.]+)\s*\)', ['a', 'b', 'c', 'd'], 'i') AS s,
  regexp_matches(reply, 'TYPE\s*\(\s*("(.*?)"|''(.*?)'')\s*\)', 'is') AS is_t, regexp_matches(reply, 'PRESS\s*\(\s*("(.*?)"|''(.*?)'')\s*\)', 'i') AS is_p FROM steps),
p1 AS (SELECT *, CASE WHEN reply = '' THEN 'NULL' WHEN c.a <> '' THEN 'CLICK' WHEN s.a <> '' THEN 'SCROLL' WHEN is_t THEN 'TYPE' WHEN is_p THEN 'PRESS'
  WHEN contains(upper(reply), 'ZOOM') THEN 'ZOOM' WHEN contains(upper(reply), 'FINISH') THEN 'FINISH' ELSE 'UNKNOWN' END AS p_type FROM p0),
parsed AS (SELECT *, TRY_CAST(CASE p_type WHEN 'CLICK' THEN c.a WHEN 'SCROLL' THEN s.a END AS DOUBLE) AS px, TRY_CAST(CASE p_type WHEN 'CLICK' THEN c.b WHEN 'SCROLL' THEN s.b END AS DOUBLE) AS py,
  TRY_CAST(CASE p_type WHEN 'SCROLL' THEN s.c END AS DOUBLE) AS px2, TRY_CAST(CASE p_type WHEN 'SCROLL' THEN s.d END AS DOUBLE) AS py2,
  CASE WHEN p_type = 'TYPE' THEN regexp_extract(reply, 'TYPE\s*\(\s*(?:"(.*?)"|''(.*?)'')\s*\)', 1, 'is') || regexp_extract(reply, 'TYPE\s*\(\s*(?:"(.*?)"|''(.*?)'')\s*\)', 2, 'is') END AS ptext,
  CASE WHEN p_type = 'PRESS' THEN upper(regexp_extract(reply, 'PRESS\s*\(\s*(?:"(.*?)"|''(.*?)'')\s*\)', 1, 'i') || regexp_extract(reply, 'PRESS\s*\(\s*(?:"(.*?)"|''(.*?)'')\s*\)', 2, 'i')) END AS pkey FROM p1)
"""


def ground(s: DataFrame) -> DataFrame:
    """Normalised ground truth as a struct ``g``."""
    from keyframe.functions import actions as A

    x, y, x2, y2 = ((F.col(c) / 100).alias(c) for c in ("xi", "yi", "x2i", "y2i"))
    kind = A.ground_type(F.col("type_id"), F.col("label"), x, y, x2, y2)
    box = F.when(F.col("pk") % 5 == 0, F.array(F.struct((y - 0.05).alias("y"), (x - 0.05).alias("x"), F.lit(0.125).alias("h"), F.lit(0.25).alias("w"))))
    return s.withColumn("g", F.struct(kind.alias("type"), x.alias("x"), y.alias("y"), x2.alias("x2"), y2.alias("y2"), F.col("type_text").alias("text"), A.ground_key(F.col("type_id")).alias("key"), F.col("label").alias("label"), box.alias("boxes")))


def answered(s: DataFrame) -> DataFrame:
    """Steps with two acceptable answers: their own action, then the next step's."""
    nxt = F.lead("g").over(Window.partitionBy("ep").orderBy("step"))
    g = ground(s)
    return g.withColumn("n", nxt).withColumn("answers", F.when(F.col("n").isNull(), F.array("g")).otherwise(F.array("g", "n"))).drop("n")


GROUND = r"""
g0 AS (SELECT *, CASE type_id WHEN 4 THEN CASE WHEN contains(label, 'scroll') OR xi <> x2i OR yi <> y2i THEN 'SCROLL' ELSE 'CLICK' END WHEN 3 THEN 'TYPE' WHEN 5 THEN 'PRESS' WHEN 6 THEN 'PRESS' WHEN 7 THEN 'PRESS' WHEN 12 THEN 'ZOOM' ELSE 'UNKNOWN' END AS g_type,
  CASE type_id WHEN 5 THEN 'BACK' WHEN 6 THEN 'HOME' WHEN 7 THEN 'ENTER' END AS g_key, xi / 100.0::DOUBLE AS gx, yi / 100.0::DOUBLE AS gy, x2i / 100.0::DOUBLE AS gx2, y2i / 100.0::DOUBLE AS gy2 FROM parsed),
g1 AS (SELECT ep, step, 0 AS pos, g_type, g_key, gx, gy, gx2, gy2, type_text, label, pk % 5 = 0 AS boxed FROM g0
  UNION ALL SELECT ep, step - 1, 1, g_type, g_key, gx, gy, gx2, gy2, type_text, label, pk % 5 = 0 FROM g0 WHERE step > 1),
q0 AS (SELECT p.ep, p.step, p.ls, p.sk, g1.pos, p.p_type, (p_type IN ('CLICK', 'SCROLL') AND (px IS NULL OR py IS NULL)) OR (p_type = 'SCROLL' AND (px2 IS NULL OR py2 IS NULL)) AS err, g1.g_type,
  lower(trim(ptext)) AS t1, lower(trim(g1.type_text)) AS t2, pkey, g1.g_key, px, py, px2, py2, g1.gx, g1.gy, g1.gx2, g1.gy2, g1.label, boxed FROM parsed p JOIN g1 ON g1.ep = p.ep AND g1.step = p.step),
q1 AS (SELECT *, CASE p_type
  WHEN 'CLICK' THEN CASE WHEN (boxed AND px BETWEEN gx - 0.05::DOUBLE AND gx - 0.05::DOUBLE + 0.25::DOUBLE AND py BETWEEN gy - 0.05::DOUBLE AND gy - 0.05::DOUBLE + 0.125::DOUBLE) OR sqrt((px - gx) * (px - gx) + (py - gy) * (py - gy)) <= 0.14::DOUBLE THEN 1.0::DOUBLE ELSE 0 END
  WHEN 'SCROLL' THEN CASE WHEN (CASE WHEN abs(py2 - py) > abs(px2 - px) THEN CASE WHEN py2 - py < 0 THEN 'scroll down' ELSE 'scroll up' END ELSE CASE WHEN px2 - px > 0 THEN 'scroll left' ELSE 'scroll right' END END) <> label THEN 0
    WHEN sqrt((px - gx) * (px - gx) + (py - gy) * (py - gy)) <= 0.14::DOUBLE AND sqrt((px2 - gx2) * (px2 - gx2) + (py2 - gy2) * (py2 - gy2)) <= 0.14::DOUBLE THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END
  WHEN 'TYPE' THEN CASE WHEN t1 = '' AND t2 = '' THEN 1 WHEN t1 = '' OR t2 = '' THEN 0 WHEN 1.0::DOUBLE - levenshtein(t1, t2) / greatest(length(t1), length(t2))::DOUBLE >= 0.8::DOUBLE THEN 1.0::DOUBLE - levenshtein(t1, t2) / greatest(length(t1), length(t2))::DOUBLE ELSE 0 END
  WHEN 'PRESS' THEN CASE WHEN pkey = g_key THEN 1 ELSE 0 END WHEN 'ZOOM' THEN 1 WHEN 'FINISH' THEN 1 ELSE 0 END AS param FROM q0),
scored AS (SELECT ep, step, ls, sk, pos, p_type AS pred_type, CASE WHEN err THEN 'None' ELSE g_type END AS gt_type, (p_type = g_type AND NOT err) AS type_ok,
  CASE WHEN p_type = g_type AND NOT err THEN 0.3::DOUBLE + param * 0.7::DOUBLE ELSE 0.0::DOUBLE END AS score FROM q1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ep, step ORDER BY score DESC, pos DESC) AS rn FROM scored) WHERE rn = 1)
"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of videos from events: a video per user, numbered by time."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("video"), n.alias("idx"), "event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("v"), F.get_json_object("props", "$.k").cast("int").alias("k"))


FRAMES = """
frames AS (SELECT user_id AS video, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS idx, event_id, event_type, CAST(round(value * 100) AS BIGINT) AS v, CAST(props ->> '$.k' AS INT) AS k FROM events)
"""


def qa(spark: SparkSession, d: str) -> DataFrame:
    """Questions from documents: answer, prediction (-1: none), type, category."""
    t = F.element_at(F.array(*map(F.lit, ("CH", "CW", "DC", "DL", "DO", "TC", "TN", "TP"))), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("qid"), (F.col("doc_id") % 5).alias("truth"), F.when(F.col("n_chars") % 7 == 0, -1).otherwise(F.col("n_chars") % 5).alias("pred"), t.alias("type"), "n_chars", "lang", "source")


QA = """
qa AS (SELECT doc_id AS qid, doc_id % 5 AS truth, CASE WHEN n_chars % 7 = 0 THEN -1 ELSE n_chars % 5 END AS pred, (['CH', 'CW', 'DC', 'DL', 'DO', 'TC', 'TN', 'TP'])[CAST(doc_id % 8 + 1 AS INT)] AS type, n_chars, lang, source FROM documents)
"""
