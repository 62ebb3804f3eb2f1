"""Main text of web pages by the maximum-scoring subsequence.

A page is read once into runs: a stretch of words with its context, or a tag. A word's context is
whether it stands in boilerplate (an element whose name, class, id or role says so), in or out of an
article element (or on a page without one), in a link, and under which block. Words score by the log-odds of their
context, tags a loss by that of their name; both are counted on labelled pages. One
linear scan finds the contiguous region of the greatest sum. The text of the region, without boilerplate
inside it, is cut into blocks.

Labelled pages: those with an article element label themselves (words in it that aren't boilerplate are
content). `label_pages` of them at most, those with the least hash, are fitted on: a sample of documented size. Their whole
texts are counted where they lie; only counts come to the driver. Each counts twice, once as if it had no article
element, so that the weights hold for such pages, too. Pages without any label get the prior weights.

Second reading: a page whose region scores under STRAY, a line or so, is read again with nav, aside, footer and menu alone as
boilerplate, for a form or a marked element may wrap it whole. That region counts if it scores STRAY at least and
GAIN times the first one's.

Defined results: null, empty and text-less pages give an empty text; whole pages are read, whatever their length, in
linear time; unclosed elements end with the element around them; a page cut off anywhere is
read to its end; repeated rows each get a row; no rows give none; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import json
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm.common import read

LABEL_PAGES = 300
SMOOTH = 2.0
MOST = 4.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never read.
RAW = frozenset("script style noscript template textarea svg math iframe object canvas select title".split())
BOILERPLATE = frozenset("nav header footer aside form button menu dialog head label fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open p.
ENDS_P = BLOCKS - {"body", "html"}
#: Words in class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus "
    "footer form header hidden legal login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion recommended related reply replies respond "
    "responses search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget widgets alert complementary contentinfo".split()
)
FREE = frozenset("html body main article".split())
#: Parts of a class that only says what a layout has: content-with-sidebar.
ABOUT = frozenset("has with no without non".split())
#: Boilerplate where marks and forms hold a whole page.
SURE = frozenset("nav footer aside menu".split())
#: A region under this score is a stray line; a second reading scores so many times as much.
STRAY, GAIN = 12.0, 5.0
#: Elements that a p outside them isn't ended in.
SCOPES = frozenset("td th table caption button marquee object applet html".split())

_TAG = re.compile(r"""</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*+>""")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_PARTS = re.compile(r"[a-z]+")


def marked(name: str, tag: str) -> bool:
    """Whether an element is boilerplate by its name or attributes."""
    if name in BOILERPLATE:
        return True
    if name in FREE or len(tag) <= len(name) + 2:
        return False
    for m in _ATTRIBUTE.finditer(tag, len(name) + 1):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            for one in value.split():
                parts = _PARTS.findall(one)
                if not MARKS.isdisjoint(parts) and ABOUT.isdisjoint(parts):
                    return True
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def runs(page: str, loose: bool = False) -> list[tuple[str, object, str | None]]:
    """A page as ('tag', name, None) and ('text', context, text). A context: (boilerplate, in article, in link, block). loose: only SURE elements are boilerplate."""
    out: list[tuple[str, object, str | None]] = []
    # Open elements: name, and the state before it. The numbers of open ones by name keep unmatched ends from a search.
    stack: list[tuple] = []
    opened: Counter = Counter()
    junk = article = link = p = False
    block, at, n = "", 0, len(page)
    lowered = None

    def end(name: str):
        """The state before the last open element of a name; those in it end with it."""
        while True:
            top, *state = stack.pop()
            opened[top] -= 1
            if top == name:
                return state

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            out.append(("text", (junk, article, link, block), page[at:lt]))
        if lt >= n:
            break
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = n if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = n if close < 0 else close + 1
            continue
        m = _NAME.match(page, lt)
        if not m:
            out.append(("text", (junk, article, link, block), "<"))
            at = lt + 1
            continue
        whole = _TAG.match(page, lt)
        at = whole.end() if whole else page.find(">", lt) + 1 or n
        tag, name = page[lt:at], m[1].lower()
        if tag[1] == "/":
            if opened[name]:
                junk, article, link, block, p = end(name)
            out.append(("tag", name, None))
            continue
        if name in RAW and not tag.endswith("/>"):
            lowered = page.lower() if lowered is None else lowered
            # Lower case keeps lengths but for a few letters; then the page itself is searched.
            close = (lowered if len(lowered) == n else page).find("</" + name, at)
            gt = -1 if close < 0 else page.find(">", close)
            at = n if gt < 0 else gt + 1
            continue
        if name in ENDS_P and p:
            junk, article, link, block, p = end("p")
        out.append(("tag", name, None))
        if name in VOID or tag.endswith("/>"):
            continue
        stack.append((name, junk, article, link, block, p))
        opened[name] += 1
        if name in ("article", "main"):
            junk, article = False, True
        elif not (name == "header" and article):
            junk = junk or (name in SURE if loose else marked(name, tag))
        link, p = link or name == "a", name == "p" or p and name not in SCOPES
        block = name if name in BLOCKS else block
    return out


def _keys(items: list, as_if_none: bool = False):
    """(key, words, content) of each run; without article elements where as_if_none."""
    has = any(kind == "text" and context[1] for kind, context, _ in items)
    for kind, what, text in items:
        if kind == "tag":
            yield ("tag", what), 1, None
        else:
            junk, article, link, block = what
            place = "none" if as_if_none or not has else "in" if article else "out"
            yield ("word", junk, place, link, block), len(text.split()), has and article and not junk


PRIOR_WORDS = {False: 1.0, True: -2.0}
PRIOR_TAG = -0.4


def prior(key: tuple) -> float:
    """The weight of what no labelled page shows."""
    if key[0] == "tag":
        return -0.05 if key[1] in ("p", "b", "i", "em", "strong", "br", "span", "a", "h1", "h2", "h3", "sup", "sub", "u", "code") else PRIOR_TAG
    _, junk, place, link, block = key
    base = PRIOR_WORDS[junk or place == "out"]
    return base * (0.3 if link and not junk else 1.0) * (1.0 if block in ("p", "h1", "h2", "h3", "blockquote", "pre", "li") else 0.6)


def counted(page: str) -> tuple[Counter, Counter]:
    """Words and tags of a labelled page by key: of content and of the rest; none of a page without content."""
    inside: Counter = Counter()
    outside: Counter = Counter()
    items = runs(page)
    labels = [c for _, _, c in _keys(items)]
    for as_if_none in (False, True) if any(labels) else ():
        content = False
        for (key, words, _), label in zip(_keys(items, as_if_none), labels, strict=True):
            content = content if label is None else label
            (inside if content else outside)[key] += words
    return inside, outside


def weights_of(inside: Counter, outside: Counter) -> dict[tuple, float]:
    """Log-odds of a word's context; of a tag, between content and the rest, and never above a small loss."""
    total = [max(1, sum(c.values())) for c in (inside, outside)]
    out = {}
    for key in inside.keys() | outside.keys():
        odds = math.log((inside[key] + SMOOTH) / total[0]) - math.log((outside[key] + SMOOTH) / total[1])
        odds = max(-MOST, min(MOST, odds))
        if key[0] == "tag":
            out[key] = min(-0.02, 0.25 * odds - 0.02 if odds < 0 else -0.02)
        elif inside[key] + outside[key] >= 20:
            # The sign is the label's majority; the odds set the size.
            out[key] = max(0.2, odds) if inside[key] >= outside[key] else min(-0.2, odds)
    return out


def fit(pages: list[str]) -> dict[tuple, float]:
    """Weights from labelled pages."""
    inside, outside = Counter(), Counter()
    for a, b in map(counted, pages):
        inside.update(a)
        outside.update(b)
    return weights_of(inside, outside)


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous stretch of the greatest sum, the first at ties; empty if none is above 0."""
    best, here, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if here <= 0:
            here, start = 0.0, i
        here += s
        if here > best:
            best, found = here, (start, i + 1)
    return found


def _region(items: list, weights: dict[tuple, float]) -> tuple[float, int, int]:
    """(score, start, end) of the best region."""
    # Boilerplate's words never enter the text: crossing them costs their tags alone.
    scores = [0.0 if key[0] == "word" and key[1] else words * weights.get(key, prior(key)) for key, words, _ in _keys(items)]
    start, end = best_region(scores)
    return sum(scores[start:end]), start, end


def _text(items: list) -> str:
    blocks, now = [], []

    def close():
        if text := " ".join(_html.unescape("".join(now)).split()):
            blocks.append(text)
        now.clear()

    for kind, what, text in items:
        if kind == "tag":
            if what == "br":
                now.append(" ")
            elif what in BLOCKS:
                close()
        elif not what[0]:
            now.append(text)
    close()
    return "\n\n".join(blocks)


def extract(page: str | None, weights: dict[tuple, float]) -> str:
    """The main text of a page: blocks joined by two line feeds. Where marks leave no more than a stray line, the page is read again without them."""
    if not page:
        return ""
    items = runs(page)
    score, start, end = _region(items, weights)
    if score < STRAY:
        again = runs(page, loose=True)
        more, a, b = _region(again, weights)
        if more >= max(STRAY, GAIN * score):
            items, start, end = again, a, b
    return _text(items[start:end])


def learned(pages: DataFrame, label_pages: int = LABEL_PAGES) -> dict[tuple, float]:
    """Weights fitted on the sample of labelled pages of a table (html); see the module. First the least hashes are found, a few bytes a page; their pages are counted on the executors."""
    labelled = pages.where(F.lower("html").contains("<article")).select("html", F.xxhash64("html").alias("h"))
    last = labelled.select("h").distinct().orderBy("h").limit(label_pages).agg(F.max("h").alias("h")).first()["h"]
    if last is None:
        return {}
    some = labelled.where(F.col("h") <= last).groupBy("h").agg(F.first("html").alias("html")).select("html")

    def counts(batches):
        import pyarrow as pa

        sides = Counter(), Counter()
        for b in batches:
            for page in b.column(0):
                for side, found in zip(sides, counted(page.as_py()), strict=True):
                    side.update(found)
        rows = [(json.dumps(key), *[side[key] for side in sides]) for key in sides[0].keys() | sides[1].keys()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)]], names=["key", "inside", "outside"])

    found = some.mapInArrow(counts, "key string, inside bigint, outside bigint").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    key = lambda r: tuple(json.loads(r["key"]))
    return weights_of(Counter({key(r): r["inside"] for r in found}), Counter({key(r): r["outside"] for r in found}))


def main_text(pages: DataFrame, weights: dict[tuple, float] | None = None) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    weights = learned(pages) if weights is None else weights
    kept = pages.select("page_id", "url", "html")

    def texts(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                out = [extract(x, weights) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return kept.mapInArrow(texts, f"page_id {kept.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))


QUERIES = {"op4_html_extraction": op4_html_extraction}
ORACLES: dict[str, str] = {}
