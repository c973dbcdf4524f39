"""Licence scans with built-in functions only: lines, whole texts, runs of lines and sentences against licence templates
by Dice coefficient over word bigrams.

A unit (each line of a text, the text as a whole, each run of lines with no more words than the largest template allows,
and each sentence, whatever lines it is wrapped over) is normalised to lower-case words of letters and digits and turned
into its set of bigrams. Of A and B bigrams, at most min(A, B) are shared, so a template is only compared with units of
A * t / (2 - t) to A * (2 - t) / t bigrams for a bound t; and a unit that reaches t shares a bigram with the template, so
units without any template's rarer words are never taken apart.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Well-known notices and whole licence texts as projects put them into files; texts of one's own may be passed
#: instead.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "reserved": ["All rights reserved."],
}


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def bigrams(text: str) -> list[str]:
    w = words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def _bigrams(w):
    """Set of bigrams of an array of words as a column expression."""
    more = lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return _let(w, lambda w: F.when(F.size(w) > 1, more(w)).otherwise(F.array().cast("array<string>")))


def _joined(texts: list[tuple[str, ...]]) -> str:
    """A regular expression for any of some sequences of characters, common beginnings once: at most places in a text it
    ends after a character."""
    heads: dict[str, list[tuple[str, ...]]] = {}
    for t in texts:
        if t:
            heads.setdefault(t[0], []).append(t[1:])
    parts = [h + _joined(rest) for h, rest in sorted(heads.items())]
    if not parts or any(not t for t in texts):  # a sequence that ends here matches whatever follows
        return ""
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def pattern(templates: dict[str, list[str]], dice: float) -> str:
    """A regular expression that every unit matches which reaches the bound with a template.

    Such a unit lacks fewer than (1 - t / (2 - t)) of a template's bigrams, so of any more than that many it has one."""
    need = set()
    for texts in templates.values():
        for text in texts:
            b = bigrams(text)
            take = min(len(b), math.floor(len(b) * (1 - dice / (2 - dice)) + 1e-9) + 1)
            need |= set(sorted(b, key=lambda x: (x not in need, -len(x), x))[:take])  # those in use already, then long ones, which are rare
    return "(?i)" + _joined([tuple("[^a-z0-9]+" if c == " " else c for c in b) for b in sorted(need)])


def _let(value, use):
    """``use(value)`` with the value worked out once: an expression named twice is otherwise worked out twice, and anew for
    each element inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(text):
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def _newlines(text):
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


#: Lines that start runs in one row, and sentences whose line ends are counted together.
BLOCK = 256


def _blocks(text, near: str, most: int):
    """Lines with words as (unit, w, near), ``BLOCK`` in a row with those behind them that their runs reach; ``near``: the line
    matches, alone or with the next one. Blocks without a match are left out."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("unit"), x.alias("line")))

    def marked(full):
        both = lambda i: F.concat_ws("\n", F.transform(F.slice(full, i + 1, 2), lambda v: v["line"]))
        return F.transform(full, lambda u, i: F.struct(u["unit"].alias("unit"), _words(u["line"]).alias("w"), both(i).rlike(near).alias("near")))

    cut = lambda m: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(m), F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: F.slice(m, b * BLOCK + 1, BLOCK + most))
    return F.filter(_let(_let(F.filter(lines, lambda u: u["line"].rlike("[A-Za-z0-9]")), marked), cut), lambda m: F.exists(m, lambda v: v["near"]))


def _reaches(block, most: int):
    """For each line that starts runs, the lines from it on that have ``most`` + 1 words at most, as (unit, n, b, bj, near): its
    words' number, its bigrams, and these with the one that leads over to the next line. Starts without a match are left out."""
    first = lambda i: F.flatten(F.transform(F.slice(block, i + 2, 1), lambda v: F.slice(v["w"], 1, 1)))
    taken = F.transform(block, lambda u, i: F.struct(u["unit"].alias("unit"), F.size(u["w"]).alias("n"), _bigrams(u["w"]).alias("b"), _bigrams(F.concat(u["w"], first(i))).alias("bj"), u["near"].alias("near")))
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
    more = lambda a, v: F.when(a["words"] + v["n"] <= most + 1, F.struct((a["words"] + v["n"]).alias("words"), (a["lines"] + 1).alias("lines"))).otherwise(F.struct(F.lit(most + 2).alias("words"), a["lines"].alias("lines")))
    held = lambda tail: F.slice(tail, 1, F.aggregate(tail, none, more, lambda a: a["lines"]))
    each = lambda m: F.transform(F.slice(m, 1, BLOCK), lambda u, i: _let(F.slice(m, i + 1, most + 1), held))
    return F.filter(_let(taken, each), lambda r: (F.size(r) > 1) & F.exists(r, lambda v: v["near"]))


def _runs(reach):
    """Runs of two and more lines from the first of ``reach`` on, up to its first match at least: (unit, last, more, b)."""
    least = F.greatest(F.lit(2), F.array_position(F.transform(reach, lambda v: v["near"]), True).cast("int"))
    of = lambda k: F.array_distinct(F.concat(F.flatten(F.transform(F.slice(reach, 1, k - 1), lambda v: v["bj"])), F.element_at(reach, k)["b"]))
    run = lambda k: F.struct(F.element_at(reach, 1)["unit"].alias("unit"), F.element_at(reach, k)["unit"].alias("last"), F.lit(True).alias("more"), of(k).alias("b"))
    return F.transform(F.sequence(least, F.size(reach)), run)


def _sentences(text, near: str):
    """Sentences with a match of ``near``: (unit, last, line), by the lines they start and end on."""

    def of(parts):
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: _newlines(F.array_join(F.slice(parts, b * BLOCK + 1, BLOCK), "")))
        each = F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda u: u["line"].rlike(near))

        def placed(sums, u):
            block = F.floor(u["i"] / BLOCK).cast("int")
            before = F.aggregate(F.slice(sums, 1, block), F.lit(0), lambda a, x: a + x) + _newlines(F.array_join(F.slice(parts, block * BLOCK + 1, u["i"] % BLOCK), ""))
            return _let(before + 1, lambda line: F.struct((line + _newlines(F.regexp_extract(u["line"], r"^\s*", 0))).cast("int").alias("unit"), (line + _newlines(u["line"])).cast("int").alias("last"), u["line"].alias("line")))

        return _let(sums, lambda sums: F.transform(each, lambda u: placed(sums, u)))

    return _let(F.split(text, r"(?<=[.!?])(?=\s)"), of)


def scan(docs: DataFrame, dice: float = 0.8, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, unit, licence, template, dice): units of each text that reach ``dice`` with a template; ``unit`` is the
    number of the line, or of the first line of a run or sentence, from 1, or 0 for the whole text (given if it has
    several lines). Lines and whole texts give a hit for each template that they reach, whether or not others fit better. Runs and sentences add what these miss: with a template
    that no line of theirs, nor the whole text, reaches; of those that overlap, the best one, the shortest and first.

    Null and empty texts have none; texts of any length are scanned whole; units of one word have no bigrams and match
    nothing. Repeated rows give their hits each; other columns play no part; an empty table gives an empty result."""
    templates = TEMPLATES if templates is None else templates
    known = [(name, i, bigrams(t)) for name, texts in sorted(templates.items()) for i, t in enumerate(texts)]
    known = [x for x in known if x[2]]
    low, high = dice / (2 - dice), (2 - dice) / dice
    most = math.floor(max((len(b) for _, _, b in known), default=0) * high + 1e-9)
    text = F.col("text").cast("string")
    near = pattern(templates, dice)
    lines = F.transform(F.split(F.col("text"), "\n"), lambda x, i: F.struct((i + 1).alias("unit"), x.alias("line")))
    # bigrams number at most words; a longer text than the largest template allows is no candidate as a whole
    whole = F.when(F.instr("text", "\n") > 0, F.array(F.struct(F.lit(0).alias("unit"), F.col("text").alias("line")))).otherwise(F.array().cast("array<struct<unit:int,line:string>>"))
    hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.col("text").rlike(near))
    unit = lambda u, more, last: F.struct(u["unit"].alias("unit"), u[last].alias("last"), F.lit(more).alias("more"), u["line"].alias("line"), F.lit(None).cast(block).alias("block"))
    block = "array<struct<unit:int,w:array<string>,near:boolean>>"
    plain = F.transform(F.concat(F.filter(lines, lambda u: u["line"].rlike(near)), whole), lambda u: unit(u, False, "unit"))
    pieces = F.transform(_sentences(F.col("text"), near), lambda u: unit(u, True, "last"))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("unit", "int"), ("last", "int"), ("more", "boolean"), ("line", "string"))]
    blocks = F.transform(_blocks(F.col("text"), near, most), lambda m: F.struct(*nothing, m.alias("block")))
    # a row for a line, whole text or sentence, or for a block of lines; a row for each start of runs; a row for each run
    texts = hits.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")  # before any explode
    found = texts.select("key", "doc_id", F.explode(F.concat(plain, pieces, blocks)).alias("u"))
    taken = "array<struct<unit:int,n:int,b:array<string>,bj:array<string>,near:boolean>>"
    found = found.select("key", "doc_id", "u", F.explode(F.when(F.col("u.block").isNull(), F.array(F.lit(None).cast(taken))).otherwise(_reaches(F.col("u.block"), most))).alias("reach"))
    alone = F.struct("u.unit", "u.last", "u.more", _bigrams(_words(F.col("u.line"))).alias("b"))
    found = found.select("key", "doc_id", F.explode(F.when(F.col("reach").isNull(), F.array(alone)).otherwise(_runs(F.col("reach")))).alias("u"))
    found = found.select("key", "doc_id", "u.unit", "u.last", "u.more", "u.b")
    cases = []
    for name, number, b in known:
        size, n = F.size("b"), len(b)
        shared = F.size(F.array_intersect("b", F.array(*map(F.lit, b))))
        # whole numbers decide: 2 * shared * 1000 >= dice * 1000 * (A + B)
        value = 2 * shared / (size + n)
        fits = size.between(math.ceil(n * low - 1e-9), math.floor(n * high + 1e-9))
        cases.append(F.when(fits & (2000 * shared >= round(1000 * dice) * (size + n)), F.struct(F.lit(name).alias("licence"), F.lit(number).alias("template"), value.cast("double").alias("dice"))))
    if not cases:
        return hits.where("false").select("doc_id", F.lit(0).alias("unit"), F.lit("").alias("licence"), F.lit(0).alias("template"), F.lit(0.0).alias("dice"))
    each = found.select("key", "doc_id", "unit", "last", "more", F.explode(F.filter(F.array(*cases), lambda c: c.isNotNull())).alias("c"))
    each = each.select("key", "doc_id", "unit", "last", "more", "c.licence", "c.template", "c.dice")
    hit = ["key", "doc_id", "licence", "template", "unit", "last", "more", "dice"]
    each = each.select(*hit).distinct()
    # A run or sentence goes where a better hit shares a line with it. Hits from one start are nested, so each line is covered
    # once for a start, by the best of the hits that reach it; only the best hit of a start, and those that stay whatever
    # covers them, look at the best one of each of their lines.
    start = ["key", "licence", "template", "unit"]
    ranked = each.withColumn("rank", F.struct("more", (-F.col("dice")).alias("d"), (F.col("last") - F.col("unit")).alias("n"), "unit"))
    down = Window.partitionBy(*start).orderBy(F.desc("last"), "rank")
    ranked = ranked.withColumns({"reached": F.min("rank").over(down.rowsBetween(Window.unboundedPreceding, 0)), "lower": F.coalesce(F.lead("last").over(down), F.col("unit") - 1), "first": F.min("rank").over(Window.partitionBy(*start))})
    looks = ~F.col("more") | (F.col("rank") == F.col("first"))
    begin = F.when(looks, F.col("unit")).otherwise(F.col("lower") + 1)
    spans = F.when(begin <= F.col("last"), F.sequence(begin, F.col("last"))).otherwise(F.array().cast("array<int>"))
    spans = ranked.select(*hit, "rank", "reached", "lower", looks.alias("looks"), F.explode(spans).alias("line"))
    best = F.min(F.when(F.col("line") > F.col("lower"), F.col("reached"))).over(Window.partitionBy("key", "licence", "template", "line"))
    full = F.max(~F.col("more") & (F.col("unit") == 0)).over(Window.partitionBy("key", "licence", "template"))
    kept = spans.withColumns({"best": best, "full": full}).where("looks").groupBy(*hit, "rank").agg(F.min("best").alias("best"), F.max("full").alias("full"))
    kept = kept.where(~F.col("more") | ~F.col("full") & (F.col("best") >= F.col("rank")))
    return kept.select("doc_id", "unit", "licence", "template", "dice")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(dice: float = 0.8) -> str:
    rows = ", ".join("('" + name.replace("'", "''") + f"', {i}, [" + ", ".join(f"'{b}'" for b in bigrams(t)) + "])" for name, texts in sorted(TEMPLATES.items()) for i, t in enumerate(texts) if bigrams(t))
    return rf"""
WITH t(licence, template, g) AS (VALUES {rows}),
l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS unit, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 0, text FROM documents WHERE text LIKE '%' || chr(10) || '%'),
w AS (SELECT doc_id, unit, list_filter(regexp_split_to_array(lower(line), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM l),
b AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS b FROM w WHERE len(w) > 1)
SELECT doc_id, CAST(unit AS INTEGER) AS unit, licence, CAST(template AS INTEGER) AS template, 2 * len(list_intersect(b, g)) / (len(b) + len(g)) AS dice
FROM b JOIN t ON 2000 * len(list_intersect(b, g)) >= {round(1000 * dice)} * (len(b) + len(g))
"""


SQL = sql()
