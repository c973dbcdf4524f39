"""Column functions over interface actions: parsing replies, normalising ground truth, similarity and step scores.

All are native expressions, so scans stay prunable and the work inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

W_TYPE, W_PARAM = 0.3, 0.7
NEAR, TEXT_LEAST = 0.14, 0.8
#: Classes every report shows, whether steps have them or not.
CLASSES = ["CLICK", "SCROLL", "TYPE", "PRESS", "ZOOM", "FINISH"]
# fixed values: the grammar of replies
_N = r"\s*([\d\.]+)\s*"
_CLICK = rf"(?i)CLICK\s*\({_N},{_N}\)"
_SCROLL = rf"(?i)SCROLL\s*\({_N},{_N},{_N},{_N}\)"
_TYPE = r"""(?is)TYPE\s*\(\s*(?:"(.*?)"|'(.*?)')\s*\)"""
_PRESS = r"""(?i)PRESS\s*\(\s*(?:"(.*?)"|'(.*?)')\s*\)"""
_FIELDS = "struct<type:string,x:double,y:double,x2:double,y2:double,text:string,key:string,error:boolean>"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_response(c: Column) -> Column:
    """Reply text to struct(type, x, y, x2, y2, text, key, error); error where a matched number cannot be read."""
    s = F.coalesce(c, F.lit(""))
    num = lambda pattern, i: F.regexp_extract(s, pattern, i).try_cast("double")
    quoted = lambda pattern: F.concat(F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2))
    kind = F.when(s == "", "NULL").when(s.rlike(_CLICK), "CLICK").when(s.rlike(_SCROLL), "SCROLL").when(s.rlike(_TYPE), "TYPE").when(s.rlike(_PRESS), "PRESS").when(F.upper(s).contains("ZOOM"), "ZOOM").when(F.upper(s).contains("FINISH"), "FINISH").otherwise("UNKNOWN")
    at = [F.when(kind == "CLICK", num(_CLICK, i)).when(kind == "SCROLL", num(_SCROLL, i)) for i in (1, 2)]
    to = [F.when(kind == "SCROLL", num(_SCROLL, i)) for i in (3, 4)]
    bad = kind.isin("CLICK", "SCROLL") & (at[0].isNull() | at[1].isNull()) | (kind == "SCROLL") & (to[0].isNull() | to[1].isNull())
    return F.struct(kind.alias("type"), at[0].alias("x"), at[1].alias("y"), to[0].alias("x2"), to[1].alias("y2"), F.when(kind == "TYPE", quoted(_TYPE)).alias("text"), F.when(kind == "PRESS", F.upper(quoted(_PRESS))).alias("key"), bad.alias("error"))


def ground_type(type_id: Column, label: Column, x, y, x2, y2) -> Column:
    moves = F.lower(F.coalesce(label, F.lit(""))).contains("scroll") | (x != x2) | (y != y2)
    return F.when(type_id == 4, F.when(moves, "SCROLL").otherwise("CLICK")).when(type_id == 3, "TYPE").when(type_id.isin(5, 6, 7), "PRESS").when(type_id == 12, "ZOOM").otherwise("UNKNOWN")


def ground_key(type_id: Column) -> Column:
    return F.when(type_id == 5, "BACK").when(type_id == 6, "HOME").when(type_id == 7, "ENTER")


def text_similarity(a: Column, b: Column) -> Column:
    a, b = F.lower(strip(a)), F.lower(strip(b))
    most = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / most)


def scroll_direction(x, y, x2, y2) -> Column:
    return F.when(F.abs(y2 - y) > F.abs(x2 - x), F.when(y2 - y < 0, "scroll down").otherwise("scroll up")).otherwise(F.when(x2 - x > 0, "scroll left").otherwise("scroll right"))


def distance(x, y, x2, y2) -> Column:
    return F.sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2))


def in_box(x, y, box: Column) -> Column:
    """``box``: struct(y, x, h, w); borders count."""
    return x.between(box["x"], box["x"] + box["w"]) & y.between(box["y"], box["y"] + box["h"])


def in_any_box(x, y, boxes: Column) -> Column:
    return F.coalesce(F.exists(boxes, lambda b: in_box(x, y, b)), F.lit(False))


def chunk_boxes(flat: Column) -> Column:
    """[y, x, h, w, ...] to boxes; an incomplete last box is left out."""
    n = F.floor(F.size(flat) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(*(F.element_at(flat, i * 4 + k + 1).alias(c) for k, c in enumerate("yxhw"))))).otherwise(F.array().cast("array<struct<y:double,x:double,h:double,w:double>>"))


def enlarge(y, x, h, w, factor: float = 1.4) -> Column:
    """Height and width grown by ``factor`` around the same centre, clipped at the screen."""
    top, left = F.greatest(F.lit(0.0), y - factor * h / 2), F.greatest(F.lit(0.0), x - factor * w / 2)
    return F.struct(top.alias("y"), left.alias("x"), F.least(F.lit(1.0), (1 + factor) * h).alias("h"), F.least(F.lit(1.0), (1 + factor) * w).alias("w"))


def param_score(p: Column, g: Column) -> Column:
    """Parameter score of parsed reply ``p`` against ground truth ``g`` of the same type; g: type, x, y, x2, y2, text,
    key, label, boxes."""
    click = F.when(in_any_box(p["x"], p["y"], g["boxes"]) | (distance(p["x"], p["y"], g["x"], g["y"]) <= NEAR), 1.0).otherwise(0.0)
    ends = (distance(p["x"], p["y"], g["x"], g["y"]) <= NEAR) & (distance(p["x2"], p["y2"], g["x2"], g["y2"]) <= NEAR)
    scroll = F.when(scroll_direction(p["x"], p["y"], p["x2"], p["y2"]) != F.lower(g["label"]), 0.0).when(ends, 1.0).otherwise(0.5)
    sim = text_similarity(p["text"], g["text"])
    return F.when(p["type"] == "CLICK", click).when(p["type"] == "SCROLL", scroll).when(p["type"] == "TYPE", F.when(sim >= TEXT_LEAST, sim).otherwise(0.0)).when(p["type"] == "PRESS", F.when(p["key"] == g["key"], 1.0).otherwise(0.0)).when(p["type"].isin("ZOOM", "FINISH"), 1.0).otherwise(0.0)


def step_score(p: Column, g: Column) -> Column:
    return F.when((p["type"] == g["type"]) & ~p["error"], F.lit(W_TYPE) + param_score(p, g) * F.lit(W_PARAM)).otherwise(0.0)


def history_text(type_id, kind, x, y, x2, y2, text) -> Column:
    n = lambda c: F.format_string("%.3f", c)
    quote = F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('\\"'))
    return F.when(kind == "CLICK", F.concat(F.lit("CLICK("), n(x), F.lit(", "), n(y), F.lit(")"))).when(kind == "SCROLL", F.concat(F.lit("SCROLL("), n(x), F.lit(", "), n(y), F.lit(", "), n(x2), F.lit(", "), n(y2), F.lit(")"))).when(kind == "TYPE", F.concat(F.lit('TYPE("'), quote, F.lit('")'))).when(kind == "PRESS", F.concat(F.lit('PRESS("'), ground_key(type_id), F.lit('")'))).when(kind == "ZOOM", "ZOOM()").when(type_id.isin(10, 11), "FINISH()").otherwise("UNKNOWN()")


def actions_match(a: Column, b: Column, boxes: Column, tap: float = 0.04) -> Column:
    """Equality of two dual-point actions: taps near or in one enlarged box; drags along the same main axis; other
    types by type id. a, b: type_id, x, y, x2, y2; ``boxes``: array of struct(y, x, h, w)."""
    is_tap = lambda s: distance(s["x"], s["y"], s["x2"], s["y2"]) <= tap
    grown = F.transform(boxes, lambda v: enlarge(v["y"], v["x"], v["h"], v["w"]))
    both = F.coalesce(F.exists(grown, lambda v: in_box(a["x"], a["y"], v) & in_box(b["x"], b["y"], v)), F.lit(False))
    near = distance(a["x"], a["y"], b["x"], b["y"]) <= NEAR
    axis = lambda s: F.abs(s["x2"] - s["x"]) > F.abs(s["y2"] - s["y"])
    dual = (a["type_id"] == 4) & (b["type_id"] == 4)
    return F.when(~dual, a["type_id"] == b["type_id"]).when(is_tap(a) != is_tap(b), False).when(is_tap(a), both | near).otherwise(axis(a) == axis(b))


#: Strokes (x, y, x2, y2) of the predicted scroll types.
STROKES = {0: (0.5, 0.8, 0.5, 0.2), 1: (0.5, 0.2, 0.5, 0.8), 8: (0.2, 0.5, 0.8, 0.5), 9: (0.8, 0.5, 0.2, 0.5)}


def predicted_points(kind: Column, x: Column, y: Column, text: Column) -> Column:
    """A predicted action as struct(type_id, touch_y, touch_x, lift_y, lift_x, typed): taps and scrolls are dual points
    (type 4), other types stand at -1; only typing (3) has text, in lower case."""
    ends = []
    for place, own in ((1, y), (0, x), (3, y), (2, x)):
        at = F.when(kind == 4, own)
        for k, stroke in STROKES.items():
            at = at.when(kind == k, F.lit(stroke[place]))
        ends.append(at.otherwise(-1.0))
    type_id = F.when(kind.isin(4, *STROKES), 4).otherwise(kind).cast("int")
    return F.struct(type_id.alias("type_id"), *(e.alias(n) for e, n in zip(ends, ("touch_y", "touch_x", "lift_y", "lift_x"))), F.when(kind == 3, F.lower(F.coalesce(text, F.lit("")))).otherwise("").alias("typed"))
