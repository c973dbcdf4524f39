"""Main text of web pages by two-pass block rules.

Pass one splits a page into blocks at block-level tags and decides each by where it stands (menus, footers, adverts,
forms, comments ... go by tag, role, class or id; article and main speak for a block), its link density, its length and
its share of stop words. Pass two gives blocks too short to decide the label of the nearest decided blocks of their
container: of both sides if these agree, else of the nearer one; without any, of the container.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import small_batches

#: What ends a tag, or opens a quoted value inside it (quotes elsewhere are ordinary characters).
_TAG_END = re.compile(r">|=\s*([\"'])")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Numbers of character references that no code point has, beyond what int() reads.
_HUGE = re.compile(r"&#[0-9]{1000,};?")
#: Content that is never text of the page.
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "object", "textarea", "select", "math", "canvas", "audio", "video"}
_SKIP = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "head", "header"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul button".split())
_CONTAINER = set("article aside body blockquote dialog details div dl fieldset figure footer form head header main menu nav ol section table ul button".split())
#: Words of a class, id or role that mark what is never the article, wherever it stands.
_HARD = re.compile(r"ads?|adv|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion)?s?|breadcrumbs?|footers?|cookies?|consent|gdpr|notices?|alerts?|disclaimers?|popups?|modals?|newsletters?|subscribe|subscriptions?|signup|login|related|recommend(?:ed|ations)?|comments?|commentlist|respond|reply|replies|discussion|disqus|pagination|pager|contentinfo|copyright", re.I)
#: Words that also name layouts which hold the article, so that article and main lift them.
_SOFT = re.compile(r"banners?|sidebars?|side|menus?|nav(?:bar|igation)?|headers?|masthead|topbar|overlays?|share|sharing|social|widgets?|toolbar|search|complementary|legal|tags?", re.I)
#: Words in front of a marked one that take its meaning away: the layout has or lacks it, or it is the article's own.
_NOT = re.compile(r"no|not|has|have|with|without|hide|hidden", re.I)
_OWN = re.compile(r"post|entry|article|story|content|section|chapter|headline|title", re.I)
_PARTS = re.compile(r"[-_]+")
_STOP = frozenset("""a an and are as at be but by for from has have he her his i in is it its not of on or she that the their they this to was we were which with you
le la les un une des du de et est en que qui dans pour pas sur au aux avec ce il elle par plus se sont son sa ne ou
der die das und ist ein eine einer den dem des im in zu von mit nicht auf für sich auch als an es er sie wird aus bei nach
el los las una uno y es que por con para del al no se su lo como más pero sus ya si""".split())


def _named(names: str) -> str | None:
    """hard or soft if a word of a class, id or role marks an element, by whole words of whole tokens."""
    found, skip = None, False
    for token in names.replace("sign-up", "signup").replace("log-in", "login").split():
        parts = _PARTS.split(token)
        for i, part in enumerate(parts):
            off = skip or i > 0 and bool(_NOT.fullmatch(parts[i - 1]))
            if off:
                continue
            if _HARD.fullmatch(part):
                return "hard"
            if _SOFT.fullmatch(part) and not (part.lower() in ("header", "headers") and i > 0 and _OWN.fullmatch(parts[i - 1])):
                found = "soft"
        skip = bool(_NOT.fullmatch(token))  # "with share"
    return found


def _label(tag: str, attributes: str, in_article: bool) -> str | None:
    """hard, soft or good for a container that decides its blocks, else None."""
    if tag in _SKIP and not (tag == "header" and in_article):
        return "hard"
    if tag == "body":
        return None
    own = None
    for m in _NAMES.finditer(attributes):
        own = max(own or "", _named(m[1] or m[2] or m[3] or "") or "", key=("", "soft", "hard").index) or None
    return own or ("good" if tag in ("article", "main") else None)


def _tag_end(page: str, at: int) -> int:
    """The place of the > that closes the tag whose attributes start at ``at``; -1 if the page ends first."""
    while m := _TAG_END.search(page, at):
        if not m[1]:
            return m.start()
        at = page.find(m[1], m.end()) + 1 or m.end()  # a quote that never closes is an ordinary character
    return -1


def _unescape(text: str) -> str:
    return html.unescape(_HUGE.sub("\ufffd", text) if len(text) > 1000 and "&#" in text else text)


class Block(NamedTuple):
    """A block's text, the length of its link text, its standing, the number of its container, and its number of links."""

    text: str
    link: int
    standing: str | None
    box: int
    links: int = 1


def blocks(page: str) -> list[Block]:
    """The blocks of a page that aren't empty.

    Standing: good inside article or main, lifted if these stand in a container that a soft word marks, hard or soft
    where a container speaks against the block, else None. One pass over the page; what is looked for in vain once
    isn't looked for again, so that the time is linear in the page whatever it holds."""
    out, buf, link, links, depth_a = [], [], 0, 0, 0
    stack: list[tuple[str, str | None, int, bool]] = [("", None, 0, False)]  # tag, standing, container, inside an article
    depth: dict[str, int] = {}
    unclosed: set[str] = set()
    number = 0
    at, n = 0, len(page)

    def close():
        nonlocal link, links
        if buf:
            text = " ".join(_unescape("".join(buf)).split())
            if text:
                out.append(Block(text, link, stack[-1][1], stack[-1][2], links))
            buf.clear()
        link, links = 0, depth_a

    def add(piece):
        nonlocal link
        buf.append(piece)
        if depth_a:
            link += len(piece)

    while at < n:
        i = page.find("<", at)
        if i < 0:
            i = n
        if i > at:
            add(page[at:i])
        if i == n:
            break
        after = page[i + 1 : i + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", i):
                till = page.find("-->", i + 4)
                at = n if till < 0 else till + 3
            elif page.startswith("<![CDATA[", i) and "]]>" not in unclosed and (till := page.find("]]>", i + 9)) >= 0:
                add(html.escape(page[i + 9 : till]))
                at = till + 3
            else:
                if page.startswith("<![CDATA[", i):
                    unclosed.add("]]>")
                till = page.find(">", i)
                at = n if till < 0 else till + 1
            continue
        m = _NAME.match(page, i + 1)
        if not m:
            add("<")
            at = i + 1
            continue
        till = _tag_end(page, m.end())
        if till < 0:
            break
        tag, end, attributes = m[1].lower(), after == "/", page[m.end() : till]
        at = till + 1
        if tag in _RAW and not end and not attributes.rstrip().endswith("/"):
            shut = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if shut:
                at = shut.end()
            elif tag in ("script", "style"):
                break
            else:
                unclosed.add(tag)  # only the tag itself goes
            continue
        if tag == "a":
            depth_a = max(0, depth_a - 1) if end else 1
            links += not end
        elif tag in ("br", "hr", "img", "input"):
            buf.append(" ")
        if tag not in _BLOCK:
            continue
        close()
        if tag in ("p", "div", "li", "td"):
            depth_a = 0
        if tag not in _CONTAINER and tag != "title":
            continue
        if end:
            if depth.get(tag):
                while True:
                    gone = stack.pop()[0]
                    depth[gone] -= 1
                    if gone == tag:
                        break
        elif not attributes.rstrip().endswith("/"):
            number += 1
            _, up, box, inside = stack[-1]
            own = "hard" if tag == "title" else _label(tag, attributes, inside)
            if up == "hard" or own == "hard":
                own = "hard"
            elif up == "soft":
                own = "lifted" if own == "good" else "soft"
            elif up == "lifted":
                own = "soft" if own == "soft" else "lifted"
            else:
                own = own or up
            stack.append((tag, own, number if own != up or tag in ("article", "main") else box, inside or tag in ("article", "main")))
            depth[tag] = depth.get(tag, 0) + 1
    close()
    return out


def _row_of_links(block: Block) -> bool:
    """Several links with no more than a sign between them, as in a menu."""
    return block.links >= 3 and len(block.text) - block.link <= 3 * block.links


def verdicts(found: list[Block], long: int = 20, stop_share: float = 0.15, link_share: float = 0.5) -> list[bool | None]:
    """Pass one: True, False, or None where a block is too short or too unlike a sentence to tell.

    Inside the article links are text, but for rows of links that stand together; elsewhere a block that is links for the
    most part goes, unless it is one link around a whole paragraph."""
    out: list[bool | None] = []
    rows = [_row_of_links(b) for b in found]
    for i, b in enumerate(found):
        words = b.text.split()
        if b.standing == "good":
            boring = rows[i] and any(0 <= j < len(found) and rows[j] and found[j].box == b.box for j in (i - 1, i + 1))
        else:
            boring = b.standing in ("hard", "soft") or b.link > link_share * len(b.text) and not (b.links == 1 and len(words) >= long)
        if boring:
            out.append(False)
        elif len(words) >= long and (b.standing == "good" or len(words) >= 3 * long or sum(w.strip(".,;:!?").lower() in _STOP for w in words) >= stop_share * len(words)):
            out.append(True)
        else:
            out.append(None)
    return out


def inherit(found: list[Block], verdict: list[bool | None]) -> list[bool]:
    """Pass two: undecided blocks take the label of the nearest decided ones of their container."""
    keep: list[bool] = []
    last: dict[int, int] = {}
    before: list[int | None] = []
    for i, block in enumerate(found):
        before.append(last.get(block.box))
        if verdict[i] is not None:
            last[block.box] = i
    nxt: dict[int, int] = {}
    after: list[int | None] = [None] * len(found)
    for i in range(len(found) - 1, -1, -1):
        after[i] = nxt.get(found[i].box)
        if verdict[i] is not None:
            nxt[found[i].box] = i
    bare = not any(b.standing == "good" for b in found) and not any(verdict)  # a page of short blocks only
    for i, block in enumerate(found):
        v = verdict[i]
        if v is None:
            p, q = before[i], after[i]
            if block.standing == "good":
                v = True
            elif p is None and q is None:
                v = bare
            elif p is None or q is None or verdict[p] == verdict[q]:
                v = verdict[q if p is None else p]
            else:
                v = verdict[p] if i - p <= q - i else verdict[q]
        keep.append(bool(v))
    return keep


def main_text(page: str | None) -> str:
    """The blocks that are kept. An article in a softly marked container counts if the page has none elsewhere; where
    nothing is kept at all, softly marked containers are judged by their blocks alone."""
    found = blocks(page or "")
    good = any(b.standing == "good" for b in found)
    found = [b._replace(standing="soft" if good else "good") if b.standing == "lifted" else b for b in found]
    keep = inherit(found, verdicts(found))
    if not any(keep) and any(b.standing == "soft" for b in found):
        freed = [b._replace(standing=None) if b.standing == "soft" else b for b in found]
        verdict = verdicts(freed)
        keep = inherit(freed, verdict) if any(verdict) else keep
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def _map(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            text = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages(page_id, url, html)``.

    Null and empty html, and pages without main text, give the empty text and 0; markup that is never closed ends with
    the page. Repeated rows give a row each; other columns play no part; an empty table gives an empty result."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_map, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
