"""Main text of web pages by tag-path ratios.

A page is read once into blocks (text between block-level tags) with their root-to-leaf tag path. For every path of a page
the text length and the punctuation per block are summed, smoothed over the page's block order with a Gaussian, fused into
one score (geometric mean of both), weighted by what the names on the path say, and compared with a threshold relative to the
page's best path. The blocks of paths above it are the page's content nodes.

The smallest element that holds (nearly) all content nodes is the article; an <article> or <main> around it that holds them
goes before what is smaller. Blocks inside it that no path chose, such as headings and short paragraphs, are kept unless
their path is named worse than the article's own or is mostly links. Names (class, id, <form>) only weigh: where all text of a
page stands under a name, the weight changes nothing. Menus, footers, sidebars and the like by tag or role are left out.

Every step is linear in the page: tags are read once, elements are numbered in page order, sums go from the last to the first.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import map_chunks

#: Share of the best path's score that makes content; width of the smoothing in blocks; share of content the article holds.
THRESHOLD, SIGMA, HOLDS = 0.25, 1.0, 0.9
#: Weights of a path under a name that means page furniture, and under one that may stand in an article as well.
FURNITURE, DOUBTFUL = 0.005, 0.4
#: Named elements inside one another lower a weight no further than this.
LEAST = 1e-9

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[^\s/>]*")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？]")

# The tag names of HTML by their role here, and the name parts that mark what is not article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr ruby rt rp".split())
SKIPPED = frozenset("head nav footer aside script style noscript template iframe svg canvas object button select textarea dialog menu audio video map datalist".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr popup modal overlay promo promotion "
    "newsletter subscribe subscription signup login comment comments commentlist disqus respond replies reply pagination pager toolbar adsbygoogle adbox adslot cookiebar cookiebanner navmenu topnav sidenav sitenav sitefooter siteheader".split()
)
DOUBTFUL_NAMES = frozenset("share sharing social related recommended recommendations notice notices alert widget widgets skip hidden header".split())
#: What follows these in a class or id says what an element has or lacks, not what it is.
MODIFIERS = frozenset("has no with without".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
SCOPES = frozenset("table td th ul ol dl article section div body html main".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _left_out(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    if tag in SKIPPED or (tag == "header" and not inside_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in SKIPPED_ROLES or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    return False


def _weight(tag: str, attributes: dict[str, str], inside_article: bool) -> float:
    """What an element's name says of its text: 1, DOUBTFUL or FURNITURE."""
    if tag == "form":
        return FURNITURE
    if tag in ("html", "body", "article", "main") or not ("class" in attributes or "id" in attributes):
        return 1.0
    names = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        names.update(itertools.takewhile(lambda x: x not in MODIFIERS, re.split(r"[^a-z0-9]+", name)))
    if not FURNITURE_NAMES.isdisjoint(names) or {"side", "bar"} <= names:
        return FURNITURE
    return DOUBTFUL if not (DOUBTFUL_NAMES - {"header"} if inside_article else DOUBTFUL_NAMES).isdisjoint(names) else 1.0


class _Element:
    """An open or closed element. Elements are numbered in page order, so `at` to `end` are those inside it."""

    __slots__ = ("article", "at", "block", "closable", "end", "out", "parent", "path", "tag", "weight")

    def __init__(self, tag: str, parent: _Element | None, at: int, path: int, weight: float, out: bool, article: bool):
        self.tag, self.parent, self.at, self.path, self.weight, self.out, self.article, self.end = tag, parent, at, path, weight, out, article, -1
        #: The nearest element, from this one up, that is not part of a line.
        self.block = parent.block if parent is not None and tag in INLINE else self
        #: The nearest element, from this one up, that a start tag may close, but not beyond the scope it stands in.
        self.closable = self if tag in CLOSED_BY else None if parent is None or tag in SCOPES else parent.closable

    def holds(self, other: _Element) -> bool:
        return self.at <= other.at < self.end


class Block:
    """Text between two block-level tags: its element, its pieces, and the length of what is inside links."""

    __slots__ = ("element", "linked", "text")

    def __init__(self, element: _Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


class _Tags:
    """The tags of a page one after another. Where quotes do not match up to its end, the rest is read without them."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, closing, attributes) of the next tag from `at`; the name is empty for comments and the like."""
        page = self.page
        while m := _OPEN.search(page, at):
            start, opening = m.start(), m[0]
            if opening == "<!--":
                end = page.find("-->", start + 2)
                return start, end + 3 if end >= 0 else len(page), "", False, ""
            if m.end() > self.last[">"]:
                return None
            if opening in ("<!", "<?"):
                return start, page.index(">", start) + 1, "", False, ""
            closing = opening[1] == "/"
            name = _NAME.match(page, start + 1 + closing)
            end = self._end(name.end())
            return start, end + 1, name[0].lower(), closing, page[name.end() : end]
        return None

    def _end(self, at: int) -> int:
        """The place of the > that ends a tag; there is one."""
        if self.quotes:
            from_ = at
            while m := _STOP.search(self.page, from_):
                if m[0] == ">":
                    return m.start()
                # a quote that nothing closes is an ordinary character
                from_ = self.page.index(m[0], m.end()) + 1 if m.start() < self.last[m[0]] else m.end()
            self.quotes = False
        return self.page.index(">", at)


def blocks_of(page: str) -> tuple[list[Block], list[_Element]]:
    """The page's blocks in order, without those left out by tag or role, and its elements."""
    paths: dict[tuple, int] = {}
    root = _Element("", None, 0, 0, 1.0, False, False)
    elements, now, out, parts, linked, links = [root], root, [], [], 0, 0
    owner, open_ = root, defaultdict(int)
    tags = _Tags(page)

    def close():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(owner, text, linked))
            parts, linked = [], 0

    def add(text: str):
        nonlocal owner, linked
        if not text or now.out:
            return
        if not parts:
            owner = now.block
        text = html.unescape(text) if "&" in text else text
        parts.append(text)
        if links:
            linked += len(text.strip())

    def leave(last: _Element):
        nonlocal now, links
        while True:
            links -= now.tag == "a"
            open_[now.tag] -= 1
            now.end = len(elements)
            now, done = now.parent, now is last
            if done:
                return

    at = 0
    while (found := tags.next(at)) is not None:
        start, end, tag, closing, rest = found
        add(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if tag not in INLINE:
                close()
            if open_[tag]:
                there = now
                while there.tag != tag:
                    there = there.parent
                leave(there)
            continue
        if tag not in INLINE:
            close() if tag != "br" else parts.append(" ") if parts else None
        if tag in VOID:
            continue
        there = now.closable
        while there is not None:
            if tag in CLOSED_BY[there.tag]:
                leave(there)
                break
            there = None if there.tag in SCOPES else there.parent.closable
        attributes = _attributes(rest) if rest.strip(" /\n\t\r") else {}
        names = attributes.get("class", "").split()
        weight = max(now.weight * _weight(tag, attributes, now.article), LEAST)
        path = paths.setdefault((now.path, tag, names[0] if names else "", weight), len(paths) + 1)
        hidden = now.out or _left_out(tag, attributes, now.article) or (tag in INLINE and weight < now.weight)
        now = _Element(tag, now, len(elements), path, weight, hidden, now.article or tag in ("article", "main"))
        elements.append(now)
        open_[tag] += 1
        links += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            at = end.end() if end else len(page)
            leave(now)
    add(page[at:])
    close()
    leave(root)
    return out, elements


def content_blocks(blocks: list[Block], threshold: float = THRESHOLD, sigma: float = SIGMA) -> tuple[list[bool], set[int]]:
    """Which blocks stand on a path whose smoothed, fused and weighted score reaches the threshold; and the paths of links."""
    chars, marks, linked, count = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for b in blocks:
        p = b.element.path
        chars[p] += len(b.text)
        marks[p] += len(_PUNCTUATION.findall(b.text))
        linked[p] += b.linked
        count[p] += 1
    links = {p for p in count if linked[p] > 0.6 * chars[p]}
    length = [0.0 if b.element.path in links else chars[b.element.path] / count[b.element.path] for b in blocks]
    points = [0.0 if b.element.path in links else marks[b.element.path] / count[b.element.path] for b in blocks]
    reach = range(-3, 4)
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in reach]
    total = sum(kernel)

    def smooth(x: list[float]) -> list[float]:
        return [sum(k * x[min(max(i + d, 0), len(x) - 1)] for k, d in zip(kernel, reach, strict=True)) / total for i in range(len(x))]

    score: dict[int, float] = defaultdict(float)
    for i, (b, x, y) in enumerate(zip(blocks, smooth(length), smooth(points), strict=True)):
        if b.element.weight < 1:  # what is named must read like text itself, not stand beside it
            x, y = min(x, length[i]), min(y, points[i])
        if b.element.path not in links:
            score[b.element.path] += b.element.weight * math.sqrt(x * (y + 0.1)) / count[b.element.path]
    best = max(score.values(), default=0.0)
    many = {p for p in links if count[p] >= 3 and linked[p] > 0.8 * chars[p]}
    return [best > 0 and score[b.element.path] >= threshold * best for b in blocks], many


def article_text(page: str | None) -> str:
    """The article's text: references decoded, white space in a block made one space, blocks joined by one space."""
    if not page:
        return ""
    blocks, elements = blocks_of(page)
    chosen, link_lists = content_blocks(blocks)
    held = [0.0] * len(elements)
    for b, c in zip(blocks, chosen, strict=True):
        if c:
            held[b.element.at] += len(b.text) * min(1.0, b.element.weight / DOUBTFUL)
    for e in reversed(elements[1:]):
        held[e.parent.at] += held[e.at]
    if not held[0]:
        return " ".join(b.text for b in blocks if b.element.article)
    # those that hold nearly all are one inside the other, so the last is the smallest
    around = [e for e in elements if held[e.at] >= HOLDS * held[0]]
    article = around[-1]
    while article.tag in ("p", "li", "h1", "h2", "h3", "td") and article.parent is not None:
        article = article.parent
    article = next((e for e in reversed(around) if e.tag in ("article", "main")), article)
    return " ".join(b.text for b, c in zip(blocks, chosen, strict=True) if article.holds(b.element) and (c or (b.element.weight >= article.weight and b.element.path not in link_lists)))


def _batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [article_text(x) for x in batch.column("html").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page. A null or empty page has the empty text, as has one without an article.

    Pages are read one by one, whole; null ids and urls are passed on, repeated rows stay, other columns are ignored.
    """
    return map_chunks(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), _batch, "page_id long, url string, text string, n_chars long", "html")
