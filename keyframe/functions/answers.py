"""Column functions that read answers, confidences, segments and score lists out of model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .actions import strip

MODES = ["s", "r", "sr", "rs", "vote", "vote_conf_and", "vote_conf_or"]


def _letter(c: Column) -> Column:
    return F.instr(F.lit("ABCDE"), F.upper(c)) - 1


def parse_letter(c: Column) -> Column:
    """A to E as 0 to 4, else -1: first character, (X), answer/choice/option X, one bare capital."""
    s = strip(F.coalesce(c, F.lit("")))
    # fixed values: the forms in which a letter answers
    bare = F.regexp_extract_all(s, F.lit(r"\b([A-E])\b"), 1)
    return F.when(s.rlike("^[A-Ea-e]"), _letter(F.substring(s, 1, 1))).when(s.rlike(r"(?i)\([A-E]\)"), _letter(F.regexp_extract(s, r"(?i)\(([A-E])\)", 1))).when(s.rlike(r"(?i)(?:answer|choice|option)[:\s]*[A-E]"), _letter(F.regexp_extract(s, r"(?i)(?:answer|choice|option)[:\s]*([A-E])", 1))).when(F.size(bare) == 1, _letter(F.element_at(bare, 1))).otherwise(-1).cast("int")


def json_text(c: Column) -> Column:
    """The JSON in a reply: a fenced object, the whole reply, or the first {...} or [...] that reads as JSON once single
    quotes are double ones (shortest matches, so nested braces are cut as they stand); else null."""
    text = F.coalesce(c, F.lit(""))
    # fixed values: fences and brackets around an answer's JSON
    fenced = F.regexp_extract(text, r"(?s)```json\n(\{.*?\})\n```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    parts = F.transform(F.regexp_extract_all(body, F.lit(r"(?s)(\{.*?\}|\[.*?\])"), 1), lambda x: F.replace(x, F.lit("'"), F.lit('"')))
    return F.when(F.try_parse_json(body).isNotNull() & (F.trim(body) != ""), body).otherwise(F.get(F.filter(parts, lambda x: F.try_parse_json(x).isNotNull()), 0))


def unwrapped(json: Column) -> Column:
    """A reply's object as JSON: itself, or the first element of a list; null for anything else."""
    first = F.get(F.from_json(json, "array<string>"), 0)
    one = F.when(F.ltrim(json).startswith("["), first).otherwise(json)
    return F.when(F.ltrim(one).startswith("{"), one)


def field_any_case(json: Column, name: str) -> Column:
    """The value of the first key of a JSON object that is ``name`` in any case, as text."""
    pairs = F.map_entries(F.from_json(json, "map<string,string>"))
    return F.get(F.filter(pairs, lambda e: F.lower(e["key"]) == name.lower()), 0)["value"]


def json_field(c: Column, field: str) -> Column:
    """A field of the JSON object in a reply."""
    return F.get_json_object(unwrapped(json_text(c)), f"$.{field}")


def sole_value(json: Column) -> Column:
    """The value of a JSON object that has one key."""
    m = F.from_json(json, "map<string,string>")
    return F.when(F.size(m) == 1, F.get(F.map_values(m), 0))


def answer(c: Column, item: Column) -> Column:
    """-1 to 4 as they are; other whole numbers give a number of 0 to 4 that depends on ``item``; else -1."""
    n = c.try_cast("int")
    return F.when(n.between(-1, 4), n).when(n.isNotNull(), F.pmod(item, F.lit(5)).cast("int")).otherwise(-1)


def confidence(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when(n.between(1, 3), n).otherwise(1)


def first_digits(c: Column) -> Column:
    """Digits of a text as a number; 0 to 4, else -1."""
    n = F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d+)", 1).try_cast("int")
    return F.when(n.between(0, 4), n).otherwise(-1)


def answer_pair(json: Column) -> Column:
    """struct(answer, confidence) of an object with ANSWER and CONFIDENCE; whole numbers as they are (an answer beyond 0 to 4 is
    -1), else the first digits of both; -1 and -1 where a field or digits are missing."""
    a, b = F.get_json_object(json, "$.ANSWER"), F.get_json_object(json, "$.CONFIDENCE")
    plain = a.try_cast("int").isNotNull() & b.try_cast("int").isNotNull()
    digits = lambda c: F.regexp_extract(c, r"(\d+)", 1).try_cast("int")
    got = F.when(plain, F.when(a.try_cast("int").between(0, 4), a.try_cast("int")).otherwise(-1)).otherwise(digits(a))
    sure = F.when(plain, b.try_cast("int")).otherwise(F.when(digits(a).isNotNull(), digits(b)))
    return F.struct(F.coalesce(got, F.lit(-1)).alias("answer"), F.coalesce(sure, F.lit(-1)).alias("confidence"))


def segment_id(c: Column) -> Column:
    """The number in a segment_id: "a-b" gives a, otherwise the first digits."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(F.when(F.contains(text, F.lit("-")), F.trim(F.get(F.split(text, "-"), 0)).try_cast("int")), text.try_cast("int"), F.regexp_extract(text, r"(\d+)", 1).try_cast("int"))


def duration(c: Column) -> Column:
    """"s-e" as struct(start, end); one number is both ends."""
    part = F.split(F.coalesce(c, F.lit("")), "-")
    start, end = (F.element_at(part, i).try_cast("int") for i in (1, -1))
    return F.struct(start.alias("start"), end.alias("end"))


def score_list(c: Column, n: Column) -> Column:
    """"[2, 1, 9]" clamped to 1 to 3; all 2 where the number of scores isn't ``n``."""
    part = F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\]\s]", ""), ","), lambda x: x.try_cast("int"))
    return F.when((F.size(part) == n) & ~F.exists(part, lambda x: x.isNull()), F.transform(part, lambda x: F.greatest(F.lit(1), F.least(F.lit(3), x)))).otherwise(F.array_repeat(F.lit(2), n))


def combine(mode: str, s, s_conf, s_low, r, r_conf, r_low) -> Column:
    """One of MODES over two answer routes."""
    s_ok, r_ok = (s != -1) & (s_conf >= s_low), (r != -1) & (r_conf >= r_low)
    same = s == r
    cases = {"s": [(s_ok, s)], "r": [(r_ok, r)], "sr": [(s_ok, s), (r_ok, r)], "rs": [(r_ok, r), (s_ok, s)], "vote": [(same, s)], "vote_conf_and": [(same & (s_conf >= s_low) & (r_conf >= r_low), s)], "vote_conf_or": [(same & ((s_conf >= s_low) | (r_conf >= r_low)), s)]}
    out = F
    for when, value in cases[mode]:
        out = out.when(when, value)
    return out.otherwise(-1)


def hms(seconds: Column) -> Column:
    """HH:MM:SS.mmm"""
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds / 60) % 60
    return F.format_string("%02d:%02d:%06.3f", hours, minutes, (seconds % 60).cast("double"))


def minutes(frame: Column, fps: Column) -> Column:
    """m:ss of a frame."""
    s = F.floor(frame / fps)
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def run_time(c: Column) -> Column:
    """A run's time stamp in either form of its writers: yyyyMMddHHmmss or yyyy_MM_dd-HH_mm_ss; else null."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(c, F.lit("yyyy_MM_dd-HH_mm_ss")))


def elapsed(start: Column, end: Column) -> Column:
    """h:mm:ss between two times, 0:00:00 where the start is unknown."""
    s = F.coalesce(F.unix_timestamp(end) - F.unix_timestamp(start), F.lit(0))
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def percent(share: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", F.coalesce(share, F.lit(0.0)).cast("double") * 100)


def to_unit(c: Column, offset: Column, size: Column, scale: Column) -> Column:
    """A canvas coordinate as a share of the picture's size, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - offset) / (size * scale)))


def to_canvas(share: Column, offset: Column, size: Column, scale: Column) -> Column:
    return offset + share * size * scale


def box_of_corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """[x, y, w, h] of two opposite corners in any order."""
    return F.array(F.least(x0, x1), F.least(y0, y1), F.abs(x1 - x0), F.abs(y1 - y0))


def pixel_boxes(boxes: Column, width: Column, height: Column) -> Column:
    """Boxes(y, x, h, w) as struct(left, top, right, bottom) in pixels inside the picture, one pixel wide and high at least."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    inside = lambda v, size: F.greatest(F.lit(0), F.least(size - 1, v.cast("int")))
    wider = lambda a, b, size: F.when(b <= a, F.least(size - 1, a + 1)).otherwise(b)

    def one(b):
        left, top = inside(F.floor(unit(b["x"]) * width), width), inside(F.floor(unit(b["y"]) * height), height)
        right, bottom = inside(F.ceil((unit(b["x"]) + unit(b["w"])) * width), width), inside(F.ceil((unit(b["y"]) + unit(b["h"])) * height), height)
        return F.struct(left.alias("left"), top.alias("top"), wider(left, right, width).alias("right"), wider(top, bottom, height).alias("bottom"))

    return F.transform(boxes, one)
