"""The training-data operators on small tables, against brute force, round trips and held-out labels."""

import gzip
import math
import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pfs
import pytest
from pyspark.sql import functions as F

from llm import decontaminate, html_text, licences, line_dedup, masked_lm, neighbours, ngram_join, pieces, toxicity, warc
from llm._scratch import Scratch

D = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, "n", 2) for r in rows], "doc_id long, text string, node string, votes int, item_id string, n_chars int")


ODD = [(None, "some words of a text with no id"), (1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, LONG), (5, LONG), (6, "one")]


def test_ngram_join_brute(spark):
    rng = np.random.default_rng(1)
    base = [[f"w{x}" for x in rng.integers(0, 400, n)] for n in (3, 7, 12, 40, 90, 300)]
    rows = []
    for b in base:
        for k in range(8):
            w = list(b)
            for _ in range(k):
                w[rng.integers(len(w))] = f"v{rng.integers(9999)}"
            rows.append((len(rows), " ".join(w)))
    got = {r.doc_id: r.component_id for r in ngram_join.similarity_join(spark, docs(spark, rows), 4, 85).collect()}

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or {tuple(w)}

    sets, up = [grams(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert got == {i: root(i) for i in range(len(rows))}


def test_ngram_join_common_passage(spark):
    """Texts that share a passage only form large groups of signatures, which most leave; near copies with that passage stay."""
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(40)]
    texts = [[f"u{i}_{j}" for j in range(160)] + passage for i in range(400)]
    for i in range(8):
        w = list(texts[0])
        w[rng.integers(160)] = f"v{i}"
        texts.append(w)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    copies = {0, *range(400, 408)}
    got = {r.doc_id: r.component_id for r in ngram_join.similarity_join(spark, docs(spark, rows), 5, 80).collect()}
    assert got == {i: 0 if i in copies else i for i, _ in rows}
    scratch, d = Scratch(spark, "test"), docs(spark, rows).select("doc_id", "text")
    packs = d.mapInArrow(ngram_join.packs_map(5, 80, 4), "bucket int, sig binary, who binary, nodes binary, sizes binary")
    found = scratch.cut(packs.repartitionById(4, "bucket").mapInArrow(ngram_join.bucket_map(80), "a long, b long, votes long, least int, sig long, members array<long>, leasts array<int>"))
    met = found.where("a is not null").groupBy("a", "b").agg(F.sum("votes").alias("votes"), F.max("least").alias("least"))
    keys = d.mapInArrow(ngram_join.keys_map(5), "doc_id long, n_shingles long, node long")
    near = {r.node for r in keys.where(F.col("doc_id").isin(*copies)).collect()}
    before = {x for r in found.where("sig is not null").collect() for x in r.members}
    after = {r.node for r in ngram_join.grouped(met, found, scratch).collect()}
    assert near <= after and len(before) > 2 * len(after)


def test_ngram_join_packed():
    """An entry in a bucket of its own takes no more than 19 bytes, whatever the number of buckets; nothing of it is lost."""
    texts = [" ".join(f"u{i}_{j}" for j in range(100 + i)) for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    sets = [s for s in ngram_join.sets_of(pa.array(texts), 5)]
    entries = sum(len(ngram_join.signatures(s, 80)[0]) for s in sets)
    for buckets in (3, 1_000_000):
        rows = [r for b in ngram_join.packs_map(5, 80, buckets)(iter([batch])) for r in b.to_pylist()]
        assert sum(len(r["who"]) for r in rows) == 2 * entries
        assert sum(len(r[c]) for r in rows for c in ("sig", "who", "nodes", "sizes")) <= 19 * entries
        twice = pa.RecordBatch.from_pylist(rows + [r | {"nodes": (np.frombuffer(r["nodes"], np.int64) + 1).tobytes()} for r in rows])
        pairs = pa.Table.from_batches(ngram_join.bucket_map(80)(iter([twice]))).to_pylist()
        assert sum(r["votes"] for r in pairs) == entries and {(r["a"], r["b"]) for r in pairs} == {(k, k + 1) for k in map(ngram_join.set_key, sets)}


def test_keep_one_leaves_texts(spark, monkeypatch):
    """The texts of documents that stay aren't shuffled while few go; the rows are the same where many do."""
    rows = [(None, "no id " * 9), (None, "a b c d e f g"), (1, None), (2, ""), (3, "a b c d e f g"), (4, "a b c d e f g"), (5, "one two"), (5, "a b c d e f g"), (6, "one two")]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = ngram_join.keep_one(spark, docs(spark, rows))
        plan = out._jdf.queryExecution().executedPlan().toString()
        kept = sorted(map(str, out.collect()))
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        monkeypatch.setattr(ngram_join, "FEW", -1)
        other = ngram_join.keep_one(spark, docs(spark, rows))
        assert "SortMergeJoin" in other._jdf.queryExecution().executedPlan().toString() and sorted(map(str, other.collect())) == kept
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert [(r.doc_id, r.text) for r in sorted(out.collect(), key=lambda r: (r.doc_id or 0, r.text or ""))] == [(None, "a b c d e f g"), (None, "no id " * 9), (1, None), (2, ""), (3, "a b c d e f g"), (5, "a b c d e f g"), (5, "one two")]


def test_ngram_join_odd(spark):
    out = ngram_join.similarity_join(spark, docs(spark, ODD), 4, 85).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(ODD) and by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert by[5].component_id == 4 and by[1].component_id == 1 and by[6].n_shingles == 1
    assert ngram_join.similarity_join(spark, docs(spark, []), 4, 85).count() == 0


def test_ngram_join_null_bridge(spark):
    """A row without an id links two others that aren't linked themselves; rows without an id may share a text."""
    w = [f"w{i}" for i in range(100)]
    texts = [" ".join(x) for x in (w, w[6:] + list("abcdef"), w[12:] + list("abcdefghijkl"))]
    sets = [set(zip(*(t.split()[i:] for i in range(4)))) for t in texts]
    j = lambda a, b: len(a & b) / len(a | b)
    assert j(sets[0], sets[1]) >= 0.85 and j(sets[1], sets[2]) >= 0.85 and j(sets[0], sets[2]) < 0.85
    for mid in (None, 2):
        rows = [(1, texts[0]), (mid, texts[1]), (3, texts[2]), (mid, texts[1])]
        got = ngram_join.similarity_join(spark, docs(spark, rows), 4, 85).collect()
        assert {r.component_id for r in got} == {1} and len(got) == 4


def test_toxicity_held_out(spark):
    got = toxicity.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.predicted == 1) == (got.toxic == 1)).mean() > 0.93


def test_toxicity_pairs():
    """Labels that depend on two words together, neither of which tells anything alone."""
    rng = np.random.default_rng(5)

    def made(n):
        texts, y = [], []
        for _ in range(n):
            a, b = rng.random(2) < 0.5
            words = [*(f"w{x}" for x in rng.integers(0, 300, 12)), *["alpha"] * int(a), *["bravo"] * int(b)]
            texts.append(" ".join(rng.permutation(words)))
            y.append(float(a != b))
        return texts, np.array(y)

    (texts, y), (other, truth) = made(4000), made(500)
    machine = toxicity.fit(list(toxicity.terms(pa.array(texts))), y, 0.5)
    assert ((machine.score(pa.array(other)) >= 0.5) == (truth == 1)).mean() > 0.98


def test_toxicity_score_brute():
    """The sum of weights and of all pairs of factors."""
    rng = np.random.default_rng(1)
    chosen = np.sort(rng.choice(toxicity.BUCKETS, 5000, replace=False))
    chosen = np.union1d(chosen, np.concatenate(list(toxicity.terms(pa.array(["some words here and there"])))))
    machine = toxicity.Machine(chosen, rng.normal(size=len(chosen)), rng.normal(0, 0.2, (len(chosen), 4)), 0.3)
    x = [int(np.searchsorted(chosen, t)) for t in next(toxicity.terms(pa.array(["some words here and there"])))]
    z = 0.3 + sum(machine.w[i] for i in x) + sum(machine.v[i] @ machine.v[j] for k, i in enumerate(x) for j in x[:k])
    assert abs(machine.score(pa.array(["some words here and there"]))[0] - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score(spark, docs(spark, ODD), labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.toxic_score <= 1 for r in out)
    assert toxicity.score(spark, docs(spark, []), labels).count() == 0


def test_pieces_distribution():
    voc = pieces.vocabulary(pieces.MODEL, 0.2)
    lat = pieces.Lattice(voc, ["to it"])
    p = {}

    def walk(word, node, ids, lp):
        if word == len(lat.word):
            p[ids] = math.exp(lp)
            return
        node = lat.root[lat.word[word]] if node is None else node
        if node < lat.words:
            return walk(word + 1, None, ids, lp)
        for e in range(lat.first[node], lat.first[node + 1]):
            walk(word, lat.to[e], (*ids, int(lat.ids[e])), lp + lat.logp[e])

    walk(0, None, (), 0.0)
    assert abs(sum(p.values()) - 1) < 1e-9
    first, second = {}, {}
    n = 4000
    got = pieces.sample(voc, ["to it"] * n, list(range(n)), 2)
    for i, rank, ids, _, _ in got:
        (first if rank == 1 else second)[i] = tuple(ids.tolist())
    assert all(first[i] != second[i] for i in range(n))
    for path, q in p.items():
        assert abs(sum(f == path for f in first.values()) / n - q) < 0.03
        two = sum(q * b / (1 - b) for other, b in p.items() if other != path)  # second draw without replacement
        assert abs(sum(f == path for f in second.values()) / n - two) < 0.03


def test_pieces_round_trip(spark):
    rows = [*ODD, (7, "Grüße, 你好 \U0001f600\n\nend  two"), (8, "a")]
    out = pieces.encode(spark, docs(spark, rows), k=3).collect()
    assert all(r.round_trip for r in out) and {r.doc_id for r in out} == {r[0] for r in rows}
    assert [r.n_pieces for r in out if r.doc_id == 2] == [0]
    assert len({tuple(r.ids) for r in out if r.doc_id == 7}) == 3


def test_pieces_without_spaces():
    """Texts without spaces take time in proportion; what no piece spans is cut, and only that."""
    voc = pieces.vocabulary(pieces.MODEL, 0.2)
    chinese = "".join(chr(0x4E00 + (i * 7919) % 20000) for i in range(20_000))
    began = time.process_time()
    got = pieces.sample(voc, [chinese], [1], 1)
    assert pieces.decode(voc, got[0][2], [len(got[0][2])]) == [chinese]
    assert time.process_time() - began < 1
    rng = np.random.default_rng(2)
    long = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 300_000))
    began = time.process_time()
    pieces.sample(voc, [long], [1], 2)
    assert time.process_time() - began < 10
    model = pieces.read_model(pieces.MODEL)
    inside = {p[i : i + 2] for p, k in model if k == 1 for i in range(len(p) - 1)}
    text = "\u2581the\u2581cat" + long[:500]
    cut = voc.apart(voc.char[np.frombuffer(text.encode("utf-32-le"), np.int32)])
    assert all(bool(c) == (text[i - 1 : i + 1] not in inside) for i, c in enumerate(cut) if i)


def test_pieces_model_file():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert [p for p, _ in pieces.read_model(pieces.MODEL)] == [sp.id_to_piece(i) for i in range(sp.get_piece_size())]


def test_pieces_decoded(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["a b", "Gr\u00fc\u00dfe, \u4f60\u597d \U0001f600\n end", "", "two  spaces", LONG[:5000]]
    sampled = pieces.encode(spark, docs(spark, list(enumerate(texts))), k=2)
    assert all(r.text == texts[r.doc_id] for r in pieces.decoded(spark, sampled).collect())
    rows = [(0, sp.encode(texts[1])), (1, []), (2, None), (3, [5, 99999]), (4, [-1]), (5, [1, 450, 2])]
    t = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, ids array<int>, text int")
    got = {r.doc_id: r.text for r in pieces.decoded(spark, t).collect()}
    assert got == {0: texts[1], 1: "", 2: None, 3: None, 4: None, 5: sp.decode([1, 450, 2])}
    assert pieces.decoded(spark, t.limit(0)).count() == 0


def test_warc_splits(spark, tmp_path):
    rows = [(1, "u", "same " * 30), (2, "v", "same " * 30), (3, None, None), (4, "w", ""), (5, "x", "\x1f\x8b\x08 in text " + LONG), (None, "y", "z"), (2, "v", "same " * 30)]
    scratch = Scratch(spark, "t")
    root = "file://" + str(tmp_path)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    files = warc.write(spark, pages, root, scratch)
    for split in (100, 5000, 1 << 20):
        got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(spark, files, root, split).collect()), key=str)
        want = [(p, len((h or "").encode()), "revisit" if p in (2, 4) else "response", {2: 1, 4: 3}.get(p)) for p, _, h in rows]
        assert got == sorted(want, key=str)
    raw = open(files.first().path, "rb").read()
    assert gzip.decompress(raw).count(b"WARC/1.1") == len(rows)
    fs, _ = pfs.FileSystem.from_uri(root)
    cut = len(raw) // 2
    assert len(list(warc.members(fs, files.first().path, 0, cut))) + len(list(warc.members(fs, files.first().path, cut, len(raw)))) == len(rows)


def test_licences_odd(spark):
    rows = [*ODD, (7, "x\nreleased under the MIT licence."), (8, "a\nLicensed under  the APACHE license, version 2.0!\nb")]
    got = {(r.doc_id, r.unit, r.licence) for r in licences.scan(docs(spark, rows)).collect()}
    assert (8, 2, "Apache-2.0") in got and all(g[0] == 8 for g in got)
    assert licences.scan(docs(spark, [])).count() == 0


def test_decontamination(spark):
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    items = [r for r in bench.collect() if len(r.text.split()) > 20][:3]
    filler = spark.read.parquet(f"{D}/documents.parquet").collect()
    rows = [(r.doc_id, r.text) for r in filler]
    base = len(rows)
    para = items[1].text.split()
    para[4] = "changed"
    rows += [(base, filler[0].text + " " + items[0].text + " " + filler[1].text), (base + 1, "pre " + " ".join(para) + " post"), (base + 2, None), (base + 3, "")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, docs(spark, rows), bench).collect()}
    assert {(base, items[0].item_id), (base + 1, items[1].item_id)} <= got
    words = lambda t: pa.array([t])
    hashed = lambda t: decontaminate._vec.words(words(t or ""), alnum=True)[0].tolist()
    every = [(r.item_id, hashed(r.text)) for r in bench.collect()]
    text = {i: hashed(t) for i, t in rows}
    for d, i in got:  # each hit stands in the whole text
        item = dict(every)[i]
        assert decontaminate.lcs(item, text[d]) >= 0.5 * len(item)
    assert decontaminate.contaminated(spark, docs(spark, []), bench).count() == 0


def test_lcs():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(0, 5, 12).tolist(), rng.integers(0, 5, 20).tolist()
        t = np.zeros((13, 21), int)
        for i in range(12):
            for j in range(20):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs(a, b) == t[12, 20]


def test_neighbours_brute(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8)).tolist()
    x[5:40] = [x[0]] * 35
    rows = [(i, v) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0, None] + [0.0] * 6)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(spark, t, t.where("vec_id % 50 = 0"), shard_rows=150).toPandas()
    a, hit = np.array(x), 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((a - a[q]) ** 2).sum(1))
        want = [i for _, i in sorted((round(v, 12), i) for i, v in enumerate(d) if i != q)][:10]
        hit += len(set(want) & set(g.vec_id))
        assert list(g.sort_values("rank").score) == sorted(g.score) and len(g) == 10
    assert hit / (10 * got.query_id.nunique()) >= 0.9
    assert got[got.query_id == 0].vec_id.tolist() == list(range(5, 15))
    assert neighbours.search(spark, t.limit(0), t.limit(0)).count() == 0


def plain_units(text):
    """(start, end, words, ends a line, normalised) of each unit, by a direct scan."""
    out, cur = [], []
    found = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    for k, (s, e) in enumerate(found):
        cur.append((s, e))
        feed = k + 1 == len(found) or "\n" in text[e : found[k + 1][0]]
        if feed or text[e - 1] in ".!?":
            out.append((cur[0][0], cur[-1][1], len(cur), feed, " ".join(text[a:b] for a, b in cur).lower()))
            cur = []
    return out


def plain_dedup(rows, unit_words, run_words, line_words):
    """{row number: (text, spans)}: the earliest unit of each kind stays, by id and place."""
    seen, out = set(), {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        us, flags = plain_units(rows[i][1]), []
        for u in us:
            flags.append(u[4] in seen)
            seen.add(u[4])
        cut, at = [False] * len(us), 0
        for j, u in enumerate(us):
            if u[3]:
                if all(flags[at : j + 1]) and sum(x[2] for x in us[at : j + 1]) >= line_words:
                    cut[at : j + 1] = [True] * (j + 1 - at)
                at = j + 1
        runs = lambda f: [(k, next((m for m in range(k, len(f)) if not f[m]), len(f))) for k in range(len(f)) if f[k] and (k == 0 or not f[k - 1])]
        for a, b in runs(flags):
            n = [u[2] for u in us[a:b]]
            if max(n) >= unit_words or sum(n) >= run_words:
                cut[a:b] = [True] * (b - a)
        text, keep, last, spans = rows[i][1], "", 0, []
        for a, b in runs(cut):
            keep += text[last : us[a][0]]
            last = us[b][0] if b < len(us) else len(text)
            spans.append((us[a][0], us[b - 1][1], sum(u[2] for u in us[a:b])))
        out[i] = (keep + text[last:] if spans else text, spans)
    return out


@pytest.mark.parametrize("params", [(8, 20, 0), (3, 5, 2)])
def test_line_dedup_brute(spark, params):
    rng = np.random.default_rng(9)
    vocab = ["a", "Bé.", "c!", "dd", "eee?", "\n", "\n", "x", "\t", "end."]
    kinds = [" ".join(rng.choice(vocab, rng.integers(1, 9))) for _ in range(25)]
    rows = [(int(i), "\n".join(rng.choice(kinds, rng.integers(0, 6)))) for i in rng.permutation(40)] + [(100, None), (101, ""), (102, " \n ")]
    want = plain_dedup(rows, *params)
    t = spark.createDataFrame([(*r, "k", 7, True) for r in rows], "doc_id long, text string, rank_id string, n_chars int, repeats boolean")
    got = {r.doc_id: r for r in line_dedup.dedup(spark, t, *params).collect()}
    assert {i: r.text for i, r in got.items()} == {rows[i][0]: x[0] for i, x in want.items()}
    assert all(got[rows[i][0]].n_chars == (len(x[0]) if x[1] else 7) for i, x in want.items()) and got[100].rank_id == "k" and got[0].repeats
    spans = {(r.doc_id, r.start_char, r.end_char, r.n_words) for r in line_dedup.removed(spark, t, *params).collect()}
    assert spans == {(rows[i][0], *s) for i, x in want.items() for s in x[1]} and spans


def test_line_dedup_odd(spark):
    out = line_dedup.dedup(spark, docs(spark, ODD))
    assert out.count() == len(ODD) and out.columns == docs(spark, []).columns
    assert {r.doc_id: r.text for r in out.collect()}[5] == "" and line_dedup.dedup(spark, docs(spark, [])).count() == 0
    text, spans = line_dedup.cut_text("é A b c d e f g h.\nrest", [0], 8, 20, 0)
    assert (text, spans) == ("rest", [(0, 18, 9)])
    same = docs(spark, [(1, "one line"), (1, "one line"), (None, "one line")])  # rows of equal id and text are one document
    assert sorted((r.doc_id or 9, r.text) for r in line_dedup.dedup(spark, same).collect()) == [(1, "one line"), (1, "one line"), (9, "")]


def plain_log_prob(model, share, table, ids, t):
    """One token, in plain loops."""
    ctx, seen = np.zeros(masked_lm.WIDTH), 0
    for j, k in enumerate(masked_lm.OFFSETS):
        if 0 <= t + k < len(ids):
            ctx += model["side"][j] * model["embed"][masked_lm.embed_rows(ids)[t + k]]
            seen += 1
    hid = np.tanh(ctx / max(seen, 1) @ model["hidden"] + model["hidden_bias"])
    z = model["out"] @ hid + model["out_bias"]
    return z[table[ids[t]]] - np.log(np.exp(z).sum()) + share[ids[t]]


def test_masked_lm_brute():
    """Scores against plain loops; a step back against differences; class probabilities sum to one."""
    rng = np.random.default_rng(4)
    model = {k: rng.normal(0, 0.3, s) for k, s in masked_lm.SHAPES.items()}
    share, table = np.zeros(masked_lm.WORDS), rng.integers(0, masked_lm.CLASSES, masked_lm.WORDS).astype(np.uint8)
    ids, first = rng.integers(0, masked_lm.WORDS, 30), np.array([0, 0, 1, 18, 30])
    got = masked_lm.log_probs(model, share, table, ids, first)
    want = [plain_log_prob(model, share, table, ids[a:b], t) for a, b in zip(first, first[1:]) for t in range(b - a)]
    assert np.allclose(got, want, atol=1e-5)
    each = [masked_lm.log_probs(model, share, table, np.concatenate((ids[:5], [int(np.flatnonzero(table == c)[0])], ids[6:10])), np.array([0, 10]))[5] for c in range(masked_lm.CLASSES)]
    assert abs(np.exp(each).sum() - 1) < 1e-5
    row, rows, own = np.repeat(np.arange(4), np.diff(first)), masked_lm.embed_rows(ids), table[ids]
    new = {k: v.copy() for k, v in model.items()}
    masked_lm.train_step(new, {k: np.full(s, 1e12) for k, s in masked_lm.SHAPES.items()}, rows, own, row, 0, 30, 1e6)
    for k, i in (("embed", (rows[3], 2)), ("side", (1, 4)), ("hidden", (2, 3)), ("out", (own[2], 1)), ("out_bias", (own[5],))):
        up, down = ({n: v.copy() for n, v in model.items()} for _ in range(2))
        up[k][i] += 1e-4
        down[k][i] -= 1e-4
        slope = (masked_lm.log_probs(up, share, table, ids, first).mean() - masked_lm.log_probs(down, share, table, ids, first).mean()) / 2e-4
        assert abs((new[k][i] - model[k][i]) - slope) < 1e-5


def test_masked_lm(spark):
    rows = [(i, "the cat sat on the mat and the dog ran to the park " * 20) for i in range(40)] + [(90, "zq wv kx pj " * 40), (91, None), (92, ""), (None, "the cat"), (93, "one"), (93, "one")]
    t = docs(spark, rows)
    out = {r.doc_id: r for r in masked_lm.score(spark, t).collect()}
    assert out[0].mean > out[90].mean and out[91].n_tokens == 0 and out[92].mean is None and out[92].score == 0
    assert abs(out[0].score - out[0].mean * out[0].n_tokens) < 1e-6
    assert out[None].n_tokens == 2 and masked_lm.score(spark, t).where("doc_id = 93").distinct().count() == 1
    other = {r.doc_id: r.score for r in masked_lm.score(spark, t.orderBy(F.rand(3)).repartition(7)).collect()}
    assert all(abs(other[i] - r.score) < 1e-3 * (1 + abs(r.score)) for i, r in out.items())  # however rows are split
    assert masked_lm.score(spark, docs(spark, [])).count() == 0
    table, share = masked_lm.vocabulary(spark, spark.createDataFrame([("a b a c",), ("b a",)], "text string"))
    n = {w: int(masked_lm.tokens(pa.array([w]))[0][0]) for w in "abc"}
    for w, k in zip("abc", (3, 2, 1)):
        per = sum(m for v, m in zip("abc", (3, 2, 1)) if table[n[v]] == table[n[w]])
        assert abs(np.exp(share[n[w]]) - k / per) < 1e-6


def test_masked_lm_company():
    """Documents' vectors against plain sums."""
    texts = ["a b a", "", "c", "b b d e"]
    ids, first = masked_lm.tokens(pa.array(texts))
    got = masked_lm.company(ids, first)
    for i in range(4):
        own = ids[first[i] : first[i + 1]]
        sign = [[1 if int(masked_lm._vec.mix(np.array([w + 0xC0FFEE], np.uint64))[0]) >> k & 1 else -1 for k in range(masked_lm.SKETCH)] for w in own.tolist()]
        total = np.sum(sign, 0) if sign else np.zeros(8)
        want = np.round(masked_lm.STEPS * total / max(1.0, np.sqrt((total**2).sum())))
        assert (got[first[i] : first[i + 1]] == want).all()


def test_masked_lm_gain(spark):
    """On documents that weren't trained on, the context is worth half a nat a token over the words' shares of the corpus."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("doc_id < 4000")
    train, rest = docs.where("doc_id % 5 > 0"), docs.where("doc_id % 5 = 0")
    words = spark.sparkContext.broadcast(masked_lm.vocabulary(spark, docs))  # numbers of words over all, as in the query
    table, share = words.value
    model = masked_lm.unpack(masked_lm.train(spark, train, words))
    n = np.bincount(table, np.where(share > -30, np.exp(share.astype(float)), 0), masked_lm.CLASSES)
    assert np.allclose(n[n > 0], 1, atol=1e-3)  # shares of each class sum to one
    lp, base, tokens = 0.0, 0.0, 0
    ids, first = masked_lm.tokens(pa.array([r.text for r in docs.collect()]))
    of = np.log(np.bincount(table[ids], minlength=masked_lm.CLASSES) / len(ids))
    for r in rest.collect():
        ids, first = masked_lm.tokens(pa.array([r.text]))
        if len(ids):
            lp += masked_lm.log_probs(model, share, table, ids, first).sum()
            base += (share[ids] + of[table[ids]]).sum()
            tokens += len(ids)
    print(lp / tokens, base / tokens)
    assert lp / tokens > base / tokens + 0.5


LINE = "This is the text of the article and it has more than twenty words in it, so that it is kept by its length."


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("<nav><a>Menu</a></nav><article><h1>T &amp; x</h1><p>a <b>b<br>c</p><script>var a='</p>'</script><p>d</article><footer>f</footer>", "T & x\na b c\nd"), ("<div class='comments'><p>no</p></div><main><p>yes</main><div id=sidebar>no</div>", "yes"), ("<p>plain", "plain"), ("<article><form>no</form><p>ok</p><aside>no</aside></article>", "ok"),
    (f'<body class="has-sidebar"><article><p>{LINE}</article>', LINE), (f'<body class="no-sidebar"><article><p>{LINE}</article>', LINE), (f'<div class="with share"><article><p>{LINE}</article></div>', LINE),
    (f'<div class="content-area left-side"><article><p>{LINE}</article></div>', LINE), (f'<article><div class="post-header"><h1>Title</h1></div><p>{LINE}</article>', f"Title\n{LINE}"), (f'<div id=comments><article class=comment><p>{LINE}</article></div>', ""),
    (f'<div class=sidebar><article><p>{LINE} teaser</article></div><main><p>{LINE}</main>', LINE), (f'<div class="page sidebar"><p>{LINE}</div>', LINE), (f'<aside><article><p>{LINE}</article></aside>', ""), ("<p>a < b &#99999999999; <i>c</i>", "a < b \ufffd c"), ("<p title='x > y'>z", "z"), ("<p title=it's>z don't", "z don't")])
def test_html(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("piece", ["<a ", "<div><p>x</p></div>", "<div>", "<a href='", "<svg>", "<![CDATA[", "&", "<article>", "</section>", "</", "<a=", "&#9"])
def test_html_hostile(piece):
    """Pages of 1 MB that are never closed, or of nothing but blocks, take time in proportion."""
    began = time.process_time()
    html_text.main_text("<div>" * 1000 + piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 4


def test_html_two_passes():
    """Both passes against plain rules over all blocks of random pages."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        found = [("w " * int(rng.integers(1, 40)) + "the and of it is " * int(rng.integers(0, 6)), int(rng.integers(0, 60)), [None, "good", "good", "hard", "soft"][rng.integers(5)], int(rng.integers(3)), int(rng.integers(0, 5))) for _ in range(12)]
        found = [html_text.Block(t.strip(), k, *rest) for t, k, *rest in found]
        first = html_text.verdicts(found)
        row = [b.links > 2 and b.link + 3 * b.links >= len(b.text) for b in found]
        for i, ((text, link, standing, box, links), v) in enumerate(zip(found, first)):
            w = text.split()
            stop = sum(x in ("the", "and", "of", "it", "is") for x in w)
            beside = [row[j] for j in (i - 1, i + 1) if 0 <= j < 12 and found[j][3] == box]
            if standing == "good" and row[i] and True in beside or standing in ("hard", "soft") or standing is None and link > len(text) / 2 and (links != 1 or len(w) < 20):
                assert v is False
            else:
                assert v is (True if len(w) >= 20 and (standing == "good" or len(w) >= 60 or stop >= 0.15 * len(w)) else None)
        second = html_text.inherit(found, first)
        for i, (_, _, standing, box, _) in enumerate(found):
            near = sorted((abs(j - i), j > i, j) for j in range(12) if found[j][3] == box and first[j] is not None)
            left, right = ([j for _, after, j in near if after is side][:1] for side in (False, True))
            if first[i] is not None:
                want = first[i]
            elif standing == "good":
                want = True
            elif not near:
                want = not any(f[2] == "good" for f in found) and not any(first)
            else:
                want = first[near[0][2]]
            assert second[i] is bool(want), (i, left, right)


MENU = "".join(f'<p><a href="/{k}">Topic {k}</a> | <a href="/{k}a">More</a> | <a href="/{k}b">Most</a></p>' for k in range(3))
LINKED = "".join(f'<li><a href="/{k}">Work number {k}</a></li>' for k in range(4))


@pytest.mark.parametrize("page,want", [
    ("<article><p>See <a>the long linked title of the work</a>.</p><p>Body of it.</p></article>", "See the long linked title of the work.\nBody of it."),
    (f"<article><p><a>All of one paragraph. {LINE}</a></p><p>End.</p></article>", f"All of one paragraph. {LINE}\nEnd."),
    (f"<article><p>{LINE}</p><ul>{LINKED}</ul></article>", LINE + "".join(f"\nWork number {k}" for k in range(4))),
    ("<article><p><a>A</a>, <a>B</a>, <a>C</a></p><p>Body.</p></article>", "A, B, C\nBody."),
    (f"<article>{MENU}<p>{LINE}</p></article>", LINE),
    (f"<div>{MENU}<p>{LINE}</p></div>", LINE),
    (f"<div><p>{LINE}</p><p><a>{LINE}</a></p></div>", f"{LINE}\n{LINE}"),
    (f"<div><p>{LINE}</p><p>{'<a>Some more words</a> ' * 40}</p></div>", LINE),
])
def test_html_links(page, want):
    """What is linked inside an article is its text; rows of links side by side are a menu, wherever they stand."""
    assert html_text.main_text(page) == want


def test_html_empty_table(spark):
    t = spark.createDataFrame([], "page_id long, url string, html string, text int, n_chars string")
    out = html_text.extract(t)
    assert out.count() == 0 and out.columns == ["page_id", "url", "text", "n_chars"]


def test_html_rows(spark):
    t = spark.createDataFrame([(1, None, None, 1), (2, "u", "<p>x", 2), (2, "u", "<p>x", 2)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(t).collect()) == [(1, "", 0), (2, "x", 1), (2, "x", 1)]


def test_pipeline(spark):
    """Each stage against plain rules over its own input, on the smallest tables."""
    import corpus_pipeline

    frame = spark.read.parquet(f"{D}/documents.parquet")
    texts = lambda f: {r.doc_id: r.text for r in f.collect()}
    cut = lambda k, f: Scratch(spark, "t").cut(corpus_pipeline.STAGES[k][1](spark, f, D))
    before = texts(frame)
    machine = toxicity.learn(spark, frame, spark.read.parquet(f"{D}/labels.parquet"))
    one = cut(0, frame)
    assert one.columns == frame.columns
    left = texts(one)
    assert set(left) == {i for i, t in before.items() if machine.score(pa.array([t], pa.string()))[0] < 0.5}

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, up = {i: grams(t) for i, t in left.items()}, {i: i for i in left}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    two = cut(1, one)
    left = texts(two)
    assert two.columns == frame.columns and set(left) == {root(i) for i in up}
    three = cut(2, two)
    rows = sorted(left.items())
    want = plain_dedup(rows, line_dedup.UNIT_WORDS, line_dedup.RUN_WORDS, line_dedup.UNIT_WORDS)
    left = texts(three)
    assert three.columns == frame.columns and left == {rows[k][0]: t for k, (t, _) in want.items()}
    four = cut(3, three)
    hashed = lambda t: decontaminate._vec.words(pa.array([t or ""]), alnum=True)[0].tolist()
    items = [hashed(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    gone = set(left) - set(texts(four))
    for i, t in left.items():
        body = hashed(t)
        assert i not in gone or any(decontaminate.lcs(x, body) >= 0.5 * len(x) for x in items)
        assert i in gone or not any(decontaminate._holds(x, body) for x in items)
    assert four.columns == frame.columns
    voc = pieces.vocabulary(pieces.MODEL, 0.2)
    for r in cut(4, four).collect():
        assert pieces.decode(voc, np.array(r.ids, np.int32), [len(r.ids)]) == [left[r.doc_id] or ""]
    assert {r[0] for r in corpus_pipeline.run(spark, D).select("doc_id").distinct().collect()} == set(texts(four))


def test_pipeline_odd(spark, tmp_path):
    """Null ids, null, empty and very long texts, repeated rows, clashing columns, empty tables: defined in every stage."""
    import corpus_pipeline

    d = str(tmp_path)
    rows = [(None, "some words of a text with no id"), (1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, LONG), (6, "one"), (6, "one"), (7, "a few words that stand alone in this table")]
    t = spark.createDataFrame([(*r, "x", i, "r", 5) for i, r in enumerate(rows)], "doc_id long, text string, node string, rank_id int, toxic_label string, n_chars int")
    t.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(6, 1, 0), (7, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "x y z")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for data in (spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/documents.parquet").limit(0)):
        frame, n = data, data.count()
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = Scratch(spark, "t").cut(stage(spark, frame, d))
            if name != "pieces":
                assert out.columns == frame.columns, name
                frame = out
        got = [(r.doc_id, r.text) for r in frame.collect()]
        if n:  # the long text and its copy, and the row that repeats, are one each
            assert sorted((i or 0, (t or "")[:20]) for i, t in got) == [(0, "some words of a text"), (1, ""), (2, ""), (3, "   \n\t "), (4, LONG[:20]), (6, "one"), (6, "one"), (7, "a few words that sta")]
            assert {r.doc_id for r in out.collect()} == {None, 1, 2, 3, 4, 6, 7}
        else:
            assert not got and not out.count()
        toxic = corpus_pipeline.toxic(spark, data, d)
        assert toxic.columns == data.columns and toxic.count() <= n
