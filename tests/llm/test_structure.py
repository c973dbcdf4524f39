"""Languages, conversations and spelling variants against plain rules, brute force and held-out labels."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import conversations, languages, spelling

D = "/root/testdata/sf0.001"
LONG = " ".join(f"wort{chr(97 + i % 23)}{chr(97 + i % 19)}lich" for i in range(30_000))


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, "n", 2.0, "w") for r in rows], "doc_id long, text string, lang string, lang_pred string, id int, lang_found string, n double, word string")


ODD = [(None, "some words of a text with no id", "en"), (1, None, "de"), (2, "", None), (3, "   \n\t ", "fr"), (4, LONG, "de"), (5, LONG, "de"), (5, LONG, "de"), (6, "one", "en"), (7, "12345 !? €", "en"), (8, "日本語", None)]


# languages


def plain_grams(text):
    low = re.sub(rb"\xc3[\x80-\x96\x98-\x9e]", lambda m: b"\xc3" + bytes([m[0][1] + 32]), text.encode()).lower()
    out = Counter()
    for word in re.findall(rb"[a-z\x80-\xff]+", low):
        w = b" " + word + b" "
        for n in range(1, languages.LONGEST + 1):
            for i in range(len(w) - n + 1):
                part = w[i : i + n]
                if part.strip() and b" " not in part[1:-1] and part != b" ":
                    out[part] += 1
    return out


def test_grams_brute():
    texts = ["Été, l'ÉCOLE - straße!", None, "", "x", "...", "a b", "Ünder  x9y\nz", " lead", "trail ", "×÷ß"]
    column = pa.array(texts)
    got = [Counter() for _ in texts]
    for owner, bucket in languages.grams(column):
        for o, b in zip(owner.tolist(), bucket.tolist()):
            got[o][b] += 1
    for t, g in zip(texts, got):
        want = Counter()
        for part, n in plain_grams(t or "").items():
            code = np.array([int.from_bytes(part, "little") + (len(part) << 56)], np.uint64)
            want[int(languages._vec.mix(code)[0] % np.uint64(languages.BUCKETS))] += n
        assert g == want, t


def test_machine_separates():
    rng = np.random.default_rng(3)
    rows, y = [], []
    for i in range(400):
        side = 1 if i % 4 else -1
        b = np.unique(np.concatenate((rng.integers(0, 500, 20), rng.integers(500, 520, 3) if side > 0 else rng.integers(520, 540, 3))))
        rows.append((b.astype(np.int32), np.full(len(b), 1 / len(b), np.float32)))
        y.append(side)
    w = languages.machine(rows, np.array(y, float))
    assert np.mean([(w[b] @ v + w[-1] > 0) == (s > 0) for (b, v), s in zip(rows, y)]) > 0.99


def test_families():
    x = np.zeros((5, 100))
    for i, (a, b) in enumerate(((0, 40), (0, 44), (50, 90), (50, 94), (52, 92))):
        x[i, a:b] = 1 / (b - a)
    assert languages.families(x, 2) == [0, 0, 2, 2, 2] and languages.families(x, 5) == list(range(5))


def test_languages_held_out(spark):
    """Half as many rows as the sample takes by default, and languages within one family at that."""
    at = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = languages.query(spark, "/root/testdata/sf0.01").join(at.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    tree = languages.learn(spark, at, number=1)
    assert set(tree.parts) == {0} and tree.parts[0].shape[1] == 6
    one = languages.identify(spark, at, tree).where(languages.held_out(F.col("doc_id"))).toPandas()
    assert (one.lang == one.lang_pred).mean() > 0.97


def test_languages_never_learn_held_out(spark):
    rows = [(i, f"wort{i} der die das" if i % 2 else f"word{i} the and of", "de" if i % 2 else "en") for i in range(400)]
    rows = [(i, t, "wrong" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    got = languages.identify(spark, docs(spark, rows), languages.learn(spark, docs(spark, rows))).collect()
    assert {r.lang_pred for r in got} == {"de", "en"} and all(r.lang_pred == ("de" if r.doc_id % 2 else "en") for r in got)


def test_languages_odd(spark):
    table = docs(spark, ODD)
    out = languages.identify(spark, table, languages.learn(spark, table)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(ODD) and [by[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4
    assert by[8].lang_pred in ("de", "en") and by[5].lang_pred == "de" and by[4].word == "w" and by[4].lang_found == "x" if "lang_found" in by[4] else True
    none = languages.learn(spark, docs(spark, []))
    assert none is None and languages.identify(spark, docs(spark, []), none).count() == 0
    assert {r.lang_pred for r in languages.identify(spark, table, None).collect()} == {"und"}
    one = languages.learn(spark, docs(spark, [(6, "one", "en"), (8, "two words", "en")]))
    assert {r.lang_pred for r in languages.identify(spark, docs(spark, [(1, "zzz", None)]), one).collect()} == {"en"}


def test_languages_sample_is_bounded(spark):
    """A hot language and repeated rows: no more than the bound, ids once."""
    rows = [(i % 900, f"text {i % 900}", "en") for i in range(3000)] + [(10_000 + i, f"texte {i}", "fr") for i in range(40)]
    got = languages.sample(docs(spark, rows), per_lang=100).groupBy("lang").count().collect()
    n = {r[0]: r[1] for r in got}
    assert 20 < n["en"] <= 100 and 20 < n["fr"] <= 40


# conversations


def brute(signature):
    """The cheapest of all edit sequences with at most two insertions at each place, judged by the grammar itself."""
    best = None
    fills = ["", "u", "a", "ua", "au"]
    for fill in itertools.product(fills, repeat=len(signature) + 1):
        for acts in itertools.product("KDUA", repeat=len(signature)):
            roles, edits, cost = fill[0], "I" * len(fill[0]), 3 * len(fill[0])
            for code, act, more in zip(signature, acts, fill[1:]):
                if act != "D" and code == "x":
                    break
                cost += {"K": 0, "D": 4}.get(act, 3) + (3 if act != "D" and code.isupper() else 0) + 3 * len(more)
                roles += {"K": code.lower(), "D": ""}.get(act, act.lower()) + more
                edits += {"U": "R", "A": "R"}.get(act, act) + "I" * len(more)
            else:
                if (best is None or (cost, edits) < best) and re.fullmatch("(s?(ua)+)?", roles):
                    best = (cost, edits)
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_solve_brute(n):
    every = list(map("".join, itertools.product("suaoxSUAO", repeat=n)))
    for signature in every if n < 3 else every[::45]:
        cost, script = conversations.solve(signature)
        assert (cost, script.translate(str.maketrans("uaUA", "IIRR"))) == brute(signature), signature


def test_solve_long():
    cost, script = conversations.solve("su" + "au" * 4000 + "A")
    assert (cost, len(script)) == (3, 8003) and set(script) == {"K"}
    assert conversations.solve("x" * 5000) == (20000, "D" * 5000)


def plain_damage(rows):
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def plain_audit(rows):
    """Every conversation by itself, with the solver for its edits."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in plain_damage(rows) if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, code, n = set(), "", Counter()
        for k, (_, role, text) in enumerate(own):
            kept = text.rstrip(conversations.WHITE)
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            first = role[:1] if role[:1] in ("s", "u", "a") else "o"
            code += "x" if fault in ("blank", "duplicate") else first.upper() if fault else first
            n["illegal"] += k > 0 and own[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        cost, script = conversations.solve(code)
        left, lines = iter(own), []
        for letter in script:
            if letter in "ua":
                lines.append({"u": "user:", "a": "assistant:"}[letter])
            else:
                _, role, text = next(left)
                if letter != "D":
                    lines.append({"U": "user", "A": "assistant"}.get(letter, role) + ":" + text)
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, script.translate(str.maketrans("uaUA", "IIRR")), hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def audits(spark, tmp_path, rows):
    at = str(tmp_path / "t")
    spark.createDataFrame([(*r, "k", True, "s") for r in rows], "conv_id long, turn long, role string, text string, kind string, lost boolean, script string").repartition(5).write.parquet(at + "/conversations.parquet")
    got = [tuple(r) for r in conversations.query(spark, at).collect()]
    assert len(got) == len({g[0] for g in got})
    return {g[0]: g[1:] for g in got}


def test_conversations_brute(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = []
    for conv in range(150):
        for turn in range(int(rng.integers(1, 9))):
            role = ["system", "user", "assistant", "tool", "user", "assistant", None, "", "useless"][int(rng.integers(9))]
            text = ["Fine.", "Cut off here", "", " \n", None, "Well! ", "So?\n", f"turn {turn}.", "a.b"][int(rng.integers(9))]
            rows.append((conv, turn + int(rng.integers(2)) * 3 * (turn > 3), role, text))
    rows = list({r[:2]: r for r in rows}.values())
    got = audits(spark, tmp_path, rows)
    want = plain_audit(rows)
    assert got == want and sum(w[5] > 0 for w in want.values()) > 100


def test_conversations_odd(spark, tmp_path):
    lost = next(t for t in range(999) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows = [(None, 1, "user", "Null id."), (None, None, "assistant", "Null turn."), (5, None, None, None), (7, lost, "user", "Gone."), (8, -(2**63), "user", "Low."), (8, 2**63 - 1, "assistant", "High."), (9, 3, "user", "x" * 500_000 + ".")]
    rows += [(10, t, "user" if t % 2 else "assistant", "Same words.") for t in range(1200)] + [(11, 4, "user", "Twice."), (11, 4, "user", "Twice.")]
    got, want = audits(spark, tmp_path, rows), plain_audit(rows)
    assert got[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got[8][0] == 2**63 - 1
    got.pop(8), want.pop(8)
    assert got == want
    none = tmp_path / "empty"
    none.mkdir()
    assert audits(spark, none, []) == {}


def test_repair_keeps_rows(spark):
    rows = [(1, 1, "assistant", "Hello."), (1, 0, "user", "Hi."), (1, 2, "user", "And then."), (2, 0, "assistant", "So."), (3, 0, "user", "Hm."), (3, 1, "user", "Well.")]
    plans, fixed = conversations.repair(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: (r.cost, r.script) for r in plans.collect()} == {1: (3, "KKKa"), 2: (3, "uK"), 3: (3, "KA")}
    assert sorted((r.conv_id, r.place, r.edit, r.turn, r.role, r.text) for r in fixed.where("conv_id > 1").collect()) == [(2, 0, "insert", None, "user", ""), (2, 1, "keep", 0, "assistant", "So."), (3, 0, "keep", 0, "user", "Hm."), (3, 1, "rerole", 1, "assistant", "Well.")]


# spelling


def near_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least_count=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least_count}
    near = {w: [v for v in n if near_one(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def test_variants_brute(spark):
    rng = np.random.default_rng(4)
    letters = list("aabbcdé×÷À")
    base = ["".join(rng.choice(letters, int(rng.integers(6, 9)))) for _ in range(12)]
    words = []
    for b in base:
        words += [b] * 400
        for _ in range(12):
            w, i = list(b), int(rng.integers(len(b)))
            kind = int(rng.integers(3))
            w[i : i + (kind != 1)] = [] if kind == 0 else [str(rng.choice(letters))]
            w = "".join(w)
            words += [w] * int(rng.integers(1, 90))
            i = int(rng.integers(len(w)))
            words += [w[:i] + str(rng.choice(letters)) + w[i:]] * int(rng.integers(1, 20))
    rng.shuffle(words)
    rows = [(i, " ".join(w if j % 3 else w.upper().lower().capitalize() if w.isascii() else w for j, w in enumerate(words[k : k + 40]))) for i, k in enumerate(range(0, len(words), 40))]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spark, docs(spark, [(*r, None) for r in rows])).collect()}
    want = plain_variants(rows)
    assert got == want and sum(w[0] is not None for w in want.values()) > 20 and any(w[1] not in (w[0], k) for k, w in want.items())


def test_variants_odd(spark):
    long = "ab" * 20_000
    rows = [(None, "nothing " * 6), (1, None), (2, ""), (3, "a b\tc"), (4, LONG), (5, LONG), (5, LONG)] + [(10 + i, long) for i in range(5)] + [(20 + i, long[:-1] + "x") for i in range(30)] + [(60 + i, "tiesaa tiesab tiesac " * 2) for i in range(6)]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spark, docs(spark, [(*r, None) for r in rows])).collect()}
    want = plain_variants(rows)
    assert got == want and want[long][0] == long[:-1] + "x" and want["tiesac"][3] == 2
    assert spelling.variants(spark, docs(spark, [])).count() == 0


def test_runs_whole():
    text = "x" * (spelling.PIECE - 3) + " " + "y" * 10 + " " + "z" * (2 * spelling.PIECE) + "-end"
    assert [len(r) for part in spelling.runs(text) for r in part] == [spelling.PIECE - 3, 10, 2 * spelling.PIECE, 3]


@pytest.mark.parametrize("module", [conversations, spelling])
def test_sql(spark, module):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as from '{D}/{t}.parquet'")
    want = con.sql(module.SQL)
    got = module.query(spark, D)
    assert got.columns == want.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
