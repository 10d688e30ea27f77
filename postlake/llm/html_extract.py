"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of tags and words.  Words score positive and tags negative,
with weights from labelled pages: pages whose authors marked the content with
an article or main element.  A linear scan finds the contiguous region of the
highest score; blocks that it touches are taken whole.  Elements that never hold
content (scripts, styles, forms, navigation, headers, footers, adverts, notices,
reader comments and the like, by element name, role or class) are left out.  A class
or id counts only as a whole ("sidebar", "sidebar-box", not "with-sidebar"), but words
of adverts, sponsors, comments and cookies also as a part of one ("google-ad",
"user-comments"), unless the element holds three quarters of the words of the article
(or page) that it stands in.  An element named as a whole stays, for the scan to judge,
if it lies outside marked content and holds an article or main element or most of the
page's words.  The same holds for forms, which may wrap a page.

Weights: for the words, the log odds of lying in content given where they stand
(inside, outside or without a marked element), the innermost block and the
classes around them; for the tags, a cost by the same odds, never positive.
They are fitted on a bounded sample of labelled pages (``sample_pages``), of
which the driver sees at most ``most_features`` counts.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by two line feeds; nothing
else is changed, dropped or cut.

Defined results: a null or empty page, or one without words, has the empty text.
Truncated and badly nested pages are read as far as they go.  Of regions with equal
scores the first is taken.  Pages of any length are read whole.  Repeated rows get
equal results.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import chunks, map_arrow

SAMPLE_PAGES, MOST_FEATURES, LEAST_SEEN = 1000, 2000, 20
CLIP = 3.0
TAG_COST = -0.3  # of a tag that no labelled page has

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas select xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul xmp".split())
CONTENT = frozenset(("article", "main"))
DROPPED = frozenset(
    "nav header footer aside form menu dialog button head audio video datalist fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
# Words in class and id names of elements without content; the second list also
# marks an article (a reader's comment, an advert).
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search "
    "share sharing social related recommended recommendations pagination pager toolbar banner skip copyright".split())
STRONG_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion "
    "comment comments reply replies respond disqus commentlist reader".split())
# Words that may stand beside them in one name ("sidebar-left").
PARTS = frozenset(
    "area bar block bottom box button buttons container form group holder icon icons inner item items left link links "
    "list main outer page panel post posts primary right secondary section site slot top unit wrap wrapper".split())
# Words that tell even as a part of a name ("google-ad", "user-comments").
TELLING = STRONG_MARKS | {"cookie", "cookies", "newsletter"}
WHOLE = 0.75  # of the words around it: an element that holds more is no part of them
STARTS = ("advert", "breadcrumb", "comment", "cookie", "newsletter", "sidebar", "sponsor", "navbar", "navigation")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)/?>"
    r"|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>?", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+")
ENDS = {name: re.compile(f"</{name}", re.I) for name in RAW}


def _strong(word: str) -> bool:
    return word in STRONG_MARKS or word.startswith(("advert", "comment", "sponsor"))


def _marked(word: str) -> bool:
    return word in MARKS or word.startswith(STARTS) or _strong(word)


def _telling(word: str) -> bool:
    return word in TELLING or _strong(word)


def _drops(name: str, attributes: str) -> tuple[bool, str, list[str]]:
    """Whether an element holds no content for sure; else how its class, id or being a
    form says so ("whole" names, a "part" of one, or ""); the words of class and id."""
    marks: list[str] = []
    sure, named = name in DROPPED and name != "form", "whole" if name == "form" else ""
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if key.lower() == "role":
            sure |= any(x in ROLES for x in NAME.findall(value))
            continue
        for token in value.split():
            found = NAME.findall(token)
            marks += found
            if name not in ("html", "body") and any(map(_strong if name in CONTENT else _marked, found)):
                if all(x in PARTS or _marked(x) for x in found):
                    named = "whole"
            if not named and name not in CONTENT and name not in ("html", "body") and any(map(_telling, found)):
                named = "part"
    return sure, "" if sure else named, marks


class Page:
    """The events of a page: ``(kind, features, words, block, text)``; kind is "w"
    for words, "t" for a tag.  Dropped elements leave their outer tags only."""

    def __init__(self, html: str):
        self.events: list[tuple] = []
        self.marked = False
        large = self._read(html, frozenset())
        if large:
            self.events, self.marked = [], False
            self._read(html, large)

    def _read(self, html: str, large: frozenset[int]) -> frozenset[int]:
        """Reads the events; the elements numbered in ``large`` stay.  Numbers of the
        elements dropped by name only that are no part of what they stand in: outside
        content those that hold an article or main element or most of the words, and
        those named in part only if they hold nearly all words around them."""
        stack: list[tuple] = []  # (name, dropped, is content, marks, held if dropped by name, words before, around)
        opened = total = contents = 0
        held: list[tuple] = []  # (element, how named, words, content elements, around)
        around: dict[int, int] = {}  # words of each content element
        inside_of: list[int] = []  # the content elements that are open
        count: Counter = Counter()
        dropped = content = 0
        block, at, end = 0, 0, len(html)
        where = "body"
        marks: list[str] = []

        def pop() -> None:
            nonlocal dropped, content, marks
            name, was, inside, own, at_open, number, before = stack.pop()
            if at_open:
                held.append((number, at_open[0], total - before, contents - at_open[1], at_open[2]))
            if inside:
                around[number] = total - before
                inside_of.pop()
            count[name] -= 1
            dropped -= was
            content -= inside
            if own:
                marks = marks[:len(marks) - len(own)]

        def say(text: str) -> None:
            nonlocal total
            n = len(text.split())
            total += n
            if text and not dropped:
                self.events.append(("w", ("in" if content else "out", where, tuple(marks)), n, block, text))

        while at < end:
            match = TOKEN.search(html, at)
            if not match:
                say(html[at:])
                break
            say(html[at:match.start()])
            at = max(match.end(), match.start() + 1)
            name = match[2] or match[5]
            if not name:
                continue
            name, closing, attributes = name.lower(), match[1] or match[4], match[3] or match[6] or ""
            if name in RAW and not closing:
                if not attributes.endswith("/"):
                    stop = ENDS[name].search(html, at)
                    if name == "xmp":  # its text is literal
                        block += 1
                        say(html[at:stop.start() if stop else end].replace("&", "&amp;"))
                    at = stop.start() if stop else end
                continue
            if name == "br":
                say(" ")
                continue
            is_block = name in BLOCK
            if is_block:
                block += 1
            if not dropped:
                self.events.append(("t", name, 0, block, ""))
            if closing:
                if count[name]:
                    while stack[-1][0] != name:
                        pop()
                    pop()
            elif name not in VOID:
                if is_block and count["p"] and any(x[0] == "p" for x in stack[-4:]):
                    while stack[-1][0] != "p":  # a block ends the open paragraph
                        pop()
                    pop()
                if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                    pop()
                sure, named, own = _drops(name, attributes)
                opened += 1
                at_open = (named, contents, inside_of[-1] if inside_of else 0) if named else None
                contents += name in CONTENT and not sure and not named
                drop = sure or named == "whole" and bool(content or opened not in large) or named == "part" and opened not in large
                inside = name in CONTENT and not drop and not dropped
                self.marked |= inside
                stack.append((name, drop, inside, own, at_open, opened, total))
                if inside:
                    inside_of.append(opened)
                count[name] += 1
                dropped += drop
                content += inside
                marks = marks + own if own else marks
            if is_block:
                where = next((x[0] for x in reversed(stack[-8:]) if x[0] in BLOCK), "body")
        while stack:
            pop()
        return frozenset(
            i for i, named, words, inner, where_ in held
            if inner or (2 * words > total if named == "whole" else words > WHOLE * (around.get(where_, 0) if where_ else total)))

    def features(self) -> Iterator[tuple[str, int, int]]:
        """(feature, words or tags inside the content, and outside): the counts
        that the weights are fitted on."""
        inside = False
        for kind, value, n, _, _ in self.events:
            if kind == "w":
                state, where, marks = value
                inside = state == "in"
                for feature in (f"state:{state}", f"block:{where}", *{f"mark:{m}" for m in marks}):
                    yield feature, n * inside, n * (not inside)
            else:
                yield f"tag:{value}", int(inside), int(not inside)


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log odds of content for each feature, clipped; tags cost, words are
    counted against the mean of all words."""
    words_in = sum(a for f, (a, b) in counts.items() if f.startswith("state:")) + 1
    words_out = sum(b for f, (a, b) in counts.items() if f.startswith("state:")) + 1
    base = math.log(words_in / words_out)
    out = {}
    for feature, (a, b) in counts.items():
        odds = max(-CLIP, min(CLIP, math.log((a + 1) / (b + 1)) - (0 if feature.startswith(("state:", "tag:")) else base)))
        out[feature] = min(-0.1, 0.2 * odds - 0.4) if feature.startswith("tag:") else odds if feature.startswith("state:") else 0.3 * odds
    return out


def extract(html: str | None, weights: dict[str, float]) -> str:
    """Text of the region with the highest score."""
    if not html:
        return ""
    page = Page(html)
    best = run = 0.0
    start, span, words = 0, None, 0
    for i, (kind, value, n, _, _) in enumerate(page.events):
        if kind == "t":
            gain = weights.get(f"tag:{value}", TAG_COST)
        else:
            state, where, marks = value
            if page.marked:
                score = weights.get(f"state:{state}", CLIP if state == "in" else -CLIP)
            else:
                score = 1.0 + weights.get(f"block:{where}", 0.0) + sum(weights.get(f"mark:{m}", 0.0) for m in marks)
            gain, words = n * score, words + n
        if run <= 0:
            run, start = 0.0, i
        run += gain
        if run > best or (span and run == best and span[0] == start):
            best, span = run, (start, i)
    if span is None:
        if not words:
            return ""
        span = (0, len(page.events) - 1)
    events = page.events
    touched = {events[i][3] for i in range(span[0], span[1] + 1) if events[i][0] == "w" and events[i][2]}
    blocks: dict[int, list[str]] = {}
    for kind, _, _, block, text in events:
        if kind == "w" and block in touched:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(x for x in lines if x)


def fit(pages: DataFrame, id_col: str, html_col: str, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from a sample of the pages with a marked element."""
    pages = pages.where(F.lower(html_col).rlike("<(article|main)[\\s>/]"))
    n = pages.count()
    share = 2.0 if not n else sample_pages / n
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1_000_000)) / 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for batch in chunks(batches, "html"):
            for html in batch.column("html").to_pylist():
                page = Page((html or b"").decode("utf-8", "replace"))
                if page.marked:
                    for feature, a, b in page.features():
                        held = total.setdefault(feature, [0, 0])
                        held[0] += a
                        held[1] += b
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([x[0] for x in total.values()], pa.int64()),
             pa.array([x[1] for x in total.values()], pa.int64())], names=["feature", "a", "b"])

    sample = pages.where(draw < share).select(F.col(html_col).cast("binary").alias("html"))
    counts = (map_arrow(sample, run, "feature string, a bigint, b bigint").groupBy("feature")
              .agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") >= LEAST_SEEN)
              .orderBy(F.desc(F.col("a") + F.col("b")), "feature").limit(MOST_FEATURES))
    return weights_of({r["feature"]: (r["a"], r["b"]) for r in counts.collect()})


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  weights: dict[str, float] | None = None, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """One row per input row: (page_id, url, text).  Map-only after the fit."""
    weights = weights if weights is not None else fit(pages, id_col, html_col, sample_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = [extract((x or b"").decode("utf-8", "replace"), weights) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    narrow = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
                          F.col(html_col).cast("binary").alias("html"))
    return map_arrow(narrow, run, "page_id bigint, url string, text string")
