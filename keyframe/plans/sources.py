"""Queries on sources, joins by key and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from keyframe.operators import joins as J
from keyframe.sources import nested
from keyframe.sources import readers as R
from keyframe.sources.checkpoint import Checkpoint
from keyframe.streaming import resume, shared

from . import surrogates as X


def explode_episodes(spark, d):
    """Nested step JSON made from lineitem, read back as rows."""
    s = X.steps(spark, d).select("ls", "ep", "step", F.struct(F.col("ep").cast("string").alias("ep_id"), F.concat(F.lit("f"), F.col("step").cast("string"), F.lit(".png")).alias("img_filename"), F.col("label").alias("goal")).alias("s"))
    eps = s.groupBy("ls", "ep").agg(F.array_sort(F.collect_list(F.struct("step", "s"))).alias("a")).select("ls", "ep", F.transform("a", lambda x: x["s"]).alias("steps"))
    doc = eps.select(F.to_json(F.map_from_entries(F.array(F.struct("ls", F.array("steps"))))).alias("text"))
    return R.steps(doc).select("task", "ep_id", "step_idx", "img_filename", "goal")


def qa_two_shapes(spark, d):
    q = X.qa(spark, d)
    item = F.struct(F.col("qid").cast("string").alias("q_uid"), F.col("source").alias("question"), F.col("lang").alias("option 0"), F.when(F.col("qid") % 3 > 0, F.col("truth").cast("int")).alias("truth"))
    text = F.when(F.col("qid") % 2 == 0, F.to_json(F.map_from_entries(F.array(F.struct(F.col("qid").cast("string"), item))))).otherwise(F.to_json(F.array(item)))
    return R.questions(q.select(text.alias("text"))).select("qid", "question", F.element_at("options", 1).alias("first_option"), "truth")


def path_parts(spark, d):
    p = X.table(spark, d, "part").select("p_partkey", F.concat(F.lit("/out/"), F.lower(F.col("p_brand")), F.lit("/uniform"), (F.col("p_size") % 10).cast("string"), F.when(F.col("p_size") % 3 == 0, "_no_cut").otherwise(""), F.lit("/run.log")).alias("path"))
    return p.select("p_partkey", *R.path_parts(F.col("path")))


def semi_local(spark, d):
    docs, labels = X.table(spark, d, "documents"), X.table(spark, d, "labels")
    return docs.select("doc_id", "lang").join(labels.select("doc_id"), "doc_id", "left_semi")


def anti_processed(spark, d):
    return resume.pending(X.table(spark, d, "documents").select("doc_id", "lang"), X.table(spark, d, "labels"), "doc_id")


def first_per_key(spark, d):
    li = X.steps(spark, d)
    return li.groupBy("ep").agg(F.min(F.struct("step", "label")).alias("m")).select("ep", F.col("m.label").alias("goal"))


def last_wins_lookup(spark, d):
    """Orders with the last note of their customer, where notes repeat keys."""
    notes = X.table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderkey", "o_orderstatus")).alias("m")).select(F.col("o_custkey").alias("c_custkey"), F.col("m.o_orderstatus").alias("note"))
    return X.table(spark, d, "customer").select("c_custkey").join(notes, "c_custkey", "left").select("c_custkey", "note")


def positional_fallback(spark, d):
    b = X.table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("b"), (F.col("vec_id") % 6).cast("int").alias("n"))
    return b.select("vec_id", F.round(F.coalesce(F.try_element_at("b", F.col("n") + 1), F.try_element_at("b", F.lit(1))).cast("double"), 6).alias("box"))


def _sets(spark, d):
    f = X.frames(spark, d)
    return tuple(f.where(F.col("event_type") == t).select("video", (F.col("k") % 20).alias("frame")) for t in ("click", "view"))


def set_union(spark, d):
    a, b = _sets(spark, d)
    return a.union(b).distinct()


def set_intersect(spark, d):
    a, b = _sets(spark, d)
    return a.intersect(b)


def set_except(spark, d):
    a, b = _sets(spark, d)
    return a.subtract(b)


def upsert_last(spark, d):
    q = X.qa(spark, d)
    return resume.upsert(q.select("qid", "pred"), q.where("qid % 4 = 0").select("qid", (F.col("truth") + 10).alias("pred")), "qid")


def exclude_then_limit(spark, d):
    q = X.qa(spark, d).select("qid", "lang").join(X.table(spark, d, "labels").select(F.col("doc_id").alias("qid")), "qid", "left_anti")
    return q.orderBy("qid").limit(50)


def id_selection_chain(spark, d):
    """Of the first 400 ids those answered wrong, without one id and without a listed set."""
    q = X.qa(spark, d).orderBy("qid").limit(400)
    return q.where((F.col("pred") != F.col("truth")) & (F.col("qid") != 7)).join(X.table(spark, d, "benchmark").select(F.col("item_id").alias("qid")), "qid", "left_anti").select("qid", "pred")


def quick_sample(spark, d):
    """The first max(1, n / 50) episodes of each task."""
    e = X.steps(spark, d).select((F.col("ls")).alias("task"), "ep").distinct()
    return J.leading(e, "task", "ep", lambda n: F.greatest(F.lit(1), F.floor(n / 50)))


def _cache(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"), "lang")
    return docs, docs.where("doc_id % 2 = 0").groupBy("key").agg(F.max("lang").alias("reply"))


def cache_hits(spark, d):
    docs, cache = _cache(spark, d)
    return docs.join(cache, "key").select("doc_id", "reply")


def cache_misses(spark, d):
    docs, cache = _cache(spark, d)
    return docs.join(cache.select("key"), "key", "left_anti").select("doc_id")


def caption_positions(spark, d):
    """Captions (turns) at sampled places, from 1; joined where longer than two."""
    c = X.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("a"))
    c = c.select("conv_id", F.transform("a", lambda x: x["role"]).alias("a"))
    return c.select("conv_id", F.array_join(F.filter("a", lambda x, i: i % 2 == 0), ". ").alias("narration"), F.size("a").alias("n"))


def batch_tally(spark, d):
    q = X.qa(spark, d)
    return q.groupBy(F.when(F.col("n_chars") % 11 == 0, "SKIP").when(F.col("pred") == -1, "ERROR").otherwise("SUCCESS").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("qid") % 2 == 0).alias("annotated"))


def repeat_to_count(spark, d):
    """Sample images repeated until there are seven."""
    f = X.frames(spark, d).where("event_type = 'signup'").groupBy("video").agg(F.slice(F.array_sort(F.collect_list("idx")), 1, 7).alias("a"))
    return f.select("video", F.array_join(F.transform(F.slice(F.flatten(F.array_repeat("a", 7)), 1, 7), lambda x: x.cast("string")), ",").alias("picked"))


def nested_entries(spark, d):
    """Conversations written as nested JSON files, a key for each, and read back by ranges of bytes: turns and characters."""
    c = X.table(spark, d, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("s"))
    whole = c.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list("s"))).alias("turns"))
    root = f"{shared.folder(spark)}/nested-{uuid.uuid4().hex}"
    nested.write_objects(whole, "conv_id", "turns", root)
    rows = nested.elements(spark, root).select(F.col("key").cast("long").alias("conv_id"), F.explode(F.from_json("value", "array<struct<turn:long,role:string,text:string>>")).alias("t"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("t.text")).alias("n_chars"), F.max("t.turn").alias("last_turn"))


def checkpoint_replay(spark, d):
    """Events committed in three batches, each of them twice, then merged: what is read has each row once."""
    f = X.frames(spark, d).select("video", "idx", "event_type", "v")
    kept = Checkpoint(spark, f"{shared.folder(spark)}/checkpoint-{uuid.uuid4().hex}")
    for part in (0, 1, 1, 2, 0):
        kept.commit(f"part-{part}", f.where(F.col("video") % 3 == part))
    kept.compact(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return kept.read().groupBy("event_type").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.countDistinct("video").alias("videos"))


QUERIES = {f.__name__: f for f in (explode_episodes, qa_two_shapes, path_parts, semi_local, anti_processed, first_per_key, last_wins_lookup, positional_fallback, set_union, set_intersect, set_except, upsert_last, exclude_then_limit, id_selection_chain, quick_sample, cache_hits, cache_misses, caption_positions, batch_tally, repeat_to_count, nested_entries, checkpoint_replay)}
_Q, _F, _S = f"WITH {X.QA}", f"WITH {X.FRAMES}", f"WITH {X.STEPS}"
_AB = f"{_F}, a AS (SELECT video, k % 20 AS frame FROM frames WHERE event_type = 'click'), b AS (SELECT video, k % 20 AS frame FROM frames WHERE event_type = 'view')"
_C = "WITH c AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0)"
SQL = {
    "nested_entries": "SELECT conv_id, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
    "checkpoint_replay": f"{_F} SELECT event_type, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, count(DISTINCT video) AS videos FROM frames GROUP BY event_type",
    "explode_episodes": f"{_S} SELECT ls AS task, CAST(ep AS VARCHAR) AS ep_id, CAST(row_number() OVER (PARTITION BY ls, ep ORDER BY step) - 1 AS INT) AS step_idx, 'f' || step || '.png' AS img_filename, label AS goal FROM steps",
    "qa_two_shapes": f"{_Q} SELECT CAST(qid AS VARCHAR) AS qid, source AS question, lang AS first_option, CAST(CASE WHEN qid % 3 > 0 THEN truth ELSE -1 END AS INT) AS truth FROM qa",
    "path_parts": r"WITH p AS (SELECT p_partkey, '/out/' || lower(p_brand) || '/uniform' || (p_size % 10) || CASE WHEN p_size % 3 = 0 THEN '_no_cut' ELSE '' END || '/run.log' AS t FROM part) SELECT p_partkey, regexp_extract(t, '([^/]+)/[^/]+/[^/]+$', 1) AS model, regexp_replace(regexp_extract(t, '([^/]+)/[^/]+$', 1), '_no_cut$', '') AS mode, regexp_extract(t, '([^/]+)/[^/]+$', 1) LIKE '%_no_cut' AS no_cut FROM p",
    "semi_local": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "anti_processed": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "first_per_key": f"{_S} SELECT ep, label AS goal FROM steps WHERE step = 1",
    "last_wins_lookup": "SELECT c_custkey, note FROM customer LEFT JOIN (SELECT o_custkey, o_orderstatus AS note FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC, o_orderstatus DESC) AS r FROM orders) WHERE r = 1) ON o_custkey = c_custkey",
    "positional_fallback": "SELECT vec_id, round(CAST(CASE WHEN vec_id % 6 < 3 THEN embedding[CAST(vec_id % 6 + 1 AS INT)] ELSE embedding[1] END AS DOUBLE), 6) AS box FROM embeddings",
    "set_union": f"{_AB} SELECT * FROM a UNION SELECT * FROM b", "set_intersect": f"{_AB} SELECT * FROM a INTERSECT SELECT * FROM b", "set_except": f"{_AB} SELECT * FROM a EXCEPT SELECT * FROM b",
    "upsert_last": f"{_Q} SELECT qid, CASE WHEN qid % 4 = 0 THEN truth + 10 ELSE pred END AS pred FROM qa",
    "exclude_then_limit": f"{_Q} SELECT qid, lang FROM qa WHERE qid NOT IN (SELECT doc_id FROM labels) ORDER BY qid LIMIT 50",
    "id_selection_chain": f"{_Q} SELECT qid, pred FROM (SELECT * FROM qa ORDER BY qid LIMIT 400) WHERE pred <> truth AND qid <> 7 AND qid NOT IN (SELECT item_id FROM benchmark)",
    "quick_sample": f"{_S} SELECT task, ep FROM (SELECT task, ep, row_number() OVER (PARTITION BY task ORDER BY ep) AS r, count(*) OVER (PARTITION BY task) AS n FROM (SELECT DISTINCT ls AS task, ep FROM steps)) WHERE r <= greatest(1, n // 50)",
    "cache_hits": "WITH c AS (SELECT text, max(lang) AS reply FROM documents WHERE doc_id % 2 = 0 GROUP BY text) SELECT doc_id, reply FROM documents JOIN c USING (text)",
    "cache_misses": f"{_C} SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM c)",
    "caption_positions": "WITH t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS r FROM conversations) SELECT conv_id, string_agg(role, '. ' ORDER BY r) FILTER (r % 2 = 1) AS narration, CAST(count(*) AS INT) AS n FROM t GROUP BY conv_id",
    "batch_tally": f"{_Q} SELECT CASE WHEN n_chars % 11 = 0 THEN 'SKIP' WHEN pred = -1 THEN 'ERROR' ELSE 'SUCCESS' END AS status, count(*) AS n, count(*) FILTER (qid % 2 = 0) AS annotated FROM qa GROUP BY ALL",
    "repeat_to_count": f"{_F}, a AS (SELECT video, list(idx ORDER BY idx) AS a FROM frames WHERE event_type = 'signup' GROUP BY video) SELECT video, (SELECT string_agg(CAST(a[CAST(i % least(len(a), 7) + 1 AS INT)] AS VARCHAR), ',' ORDER BY i) FROM range(7) AS t(i)) AS picked FROM a",
}
