"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams its events into blocks, the lines of the page. Each line has a ratio of
characters to tags; the ratios are smoothed by a Gaussian kernel and lines at or over their standard deviation
form the content cluster. The element that holds most of this cluster is its core, whose blocks, short ones included, are the
text; outside it the cluster's lines of high ratios of their own are, and headings, and paragraphs with no
fewer characters than tags, unless they are links. Where elements are an article by their tag, only
what lies in them counts. Elements that are something else by their tag or role are left out. A form, or a class or id that says so,
counts as a whole name only, and not against the cluster: where no other part of the page is an article by its tag, an element that
holds half of the cluster is no boilerplate.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by their role, and words that mark boilerplate in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
NEVER = frozenset(
    "script style noscript template svg math iframe object canvas audio video head title nav footer aside button select "
    "textarea input label legend datalist output dialog menu search".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
REGION = frozenset("article main".split())
CONTAINERS = frozenset("article body center div html main section table td".split())
PROSE = HEADING | frozenset("p blockquote figcaption pre dd".split())
CLOSES_P = BLOCK - frozenset("body head html option caption tbody td tfoot th thead tr".split())
SIBLINGS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "table tr"),
    "th": ("td th", "table tr"), "option": ("option", "select"),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply discussion".split())
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar sidebars footer masthead topbar cookie cookies consent gdpr notice notices alert notification announcement disclaimer "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget widgets toolbar "
    "pagination pager copyright skip menus banners sponsors rail".split()
)
#: Words that may stand beside a mark in one name (``share-buttons``) without making it another thing (``share-price``).
BESIDE = frozenset(
    "area articles bar block body bottom box button buttons col column container content global group header holder icon icons inner item items "
    "left link links list main message outer page panel posts primary right row secondary section site slot stories text top unit wrap wrapper".split()
)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _mark(names: str) -> str:
    """What the class and id names of an element say it is: ``comments``, ``soft`` for other boilerplate, ``header`` or nothing."""
    said = set()
    for name in names.split():
        words = {w.lower() for w in PARTS.findall(name)}
        for mark, marks in (("comments", COMMENTS), ("soft", MARKED), ("header", {"header"})):
            if words & marks and words <= marks | BESIDE:
                said.add(mark)
    return next((m for m in ("comments", "soft", "header") if m in said), "")


class _Element:
    """An open element with what its lines take over from it and all around it; ``soft`` is the nearest element that its name alone marks."""

    __slots__ = ("name", "key", "kind", "kept", "soft", "titles", "region", "listed", "linked")

    def __init__(self, name: str, key: int, kind: str, region: bool, around: _Element) -> None:
        self.name, self.key, self.kind = name, key, kind
        self.region = key if region else around.region
        self.listed = name in ("ul", "ol") or around.listed
        self.linked = name == "a" or (around.linked and name not in BLOCK)
        self.kept, self.titles, self.soft = around.kept, around.titles, around.soft
        if kind == "header":
            # a header inside the article holds its title; a page's own header goes
            self.titles, self.kept = self.kept and self.region > 0, False
        elif kind == "soft":
            self.soft = key
        elif kind:
            self.kept = self.titles = False
        elif self.titles and name in HEADING:
            self.kept = True


class _Page:
    """What is around all elements."""

    key, region, soft, kept, titles, listed, linked = 0, 0, 0, True, False, False, False


class _Line:
    __slots__ = ("pieces", "tags", "links", "of")

    def __init__(self, of: _Element | type[_Page]) -> None:
        self.pieces: list[str] = []
        self.tags = self.links = 0
        self.of = of


class PageLines(HTMLParser):
    """Turns parser events into lines; unclosed and misnested elements are closed as browsers do."""

    def __init__(self, unclosed: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.unclosed = unclosed  # marked elements, by key, that an article inside them ends
        self.doubtful: set[int] = set()  # those around an article that no end tag has closed yet
        self.lines: list[_Line] = []
        self.stack: list[_Element] = []
        self.open: Counter[str] = Counter()
        self.kinds: list[_Element] = []  # those of the stack that are marked, in order
        self.around: list[int] = [0]  # the element around each one, by its key; keys ascend in the order of the page, and 0 is the page
        self.names = [""]
        self.line: _Line | None = None
        self.pending = 0

    def _cut(self) -> None:
        self.line = None

    def _current(self) -> _Line:
        if self.line is None:
            self.line = _Line(self.stack[-1] if self.stack else _Page)
            self.line.tags, self.pending = self.pending, 0
            self.lines.append(self.line)
        return self.line

    def _drop(self, low: int, high: int | None = None) -> None:
        """Take elements off the stack, from place ``low`` on or only up to ``high``."""
        for e in self.stack[low:high]:
            self.open[e.name] -= 1
            if e.kind:
                self.kinds.remove(e) if self.kinds[-1] is not e else self.kinds.pop()
        del self.stack[low:high]

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections, which HTML doesn't have, are comments up to the next ">"."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for line numbers

    def _kind(self, name: str, attrs: list[tuple[str, str | None]]) -> str:
        if name in NEVER:
            return "other"
        if name == "header":
            return "header"
        if not attrs:
            return "soft" if name == "form" else ""
        given = {k: v or "" for k, v in attrs}
        if "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display:\s*none|visibility:\s*hidden", given.get("style", "")):
            return "other"
        if given.get("role", "").lower() in ROLES:
            return "other"
        if name in ("body", "html", "main"):
            return ""
        mark = _mark(f"{given.get('class', '')} {given.get('id', '')}") or ("soft" if name == "form" else "")
        return "" if mark == "header" and (name in HEADING or name in REGION) else mark

    def handle_starttag(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        self.pending += 1
        if self.line is not None:
            self.line.tags += 1
            self.pending = 0
        if name in VOID:
            if name == "hr":
                self._cut()
            elif name == "br":
                self.handle_data("\n")
            return
        block = name in BLOCK
        if name in CLOSES_P:
            self._close(("p",), ("article", "section", "div", "td", "li", "button", "table"))
        if name in SIBLINGS:
            ends, within = SIBLINGS[name]
            self._close(tuple(ends.split()), tuple(within.split()))
        kind = self._kind(name, attrs)
        if name in REGION and not kind and self.kinds and self.kinds[0].kind != "comments":
            # an article that begins inside an unclosed menu or advert ends it; one inside a closed one is a part of it, and one inside reader
            # comments a comment
            outer = self.kinds[0]
            if outer.key in self.unclosed:
                self._drop(next(i for i, e in enumerate(self.stack) if e is outer))
            else:
                self.doubtful.add(outer.key)
        around = self.stack[-1] if self.stack else _Page
        region = kind in ("", "soft") and (name in REGION or bool(attrs) and dict(attrs).get("role") == "main")
        self.around.append(around.key)
        self.names.append(name)
        element = _Element(name, len(self.around) - 1, kind, region, around)
        self.stack.append(element)
        self.open[name] += 1
        if kind:
            self.kinds.append(element)
        if block or kind:
            self._cut()

    def handle_startendtag(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(name, attrs)
        if name not in VOID and name in ("svg", "path", "iframe"):
            self.handle_endtag(name)

    def _close(self, names: tuple[str, ...], within: tuple[str, ...]) -> None:
        if not any(self.open[n] for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i].name
            if name in names:
                self._drop(i)
                self._cut()
                return
            if name in within or name in REGION or name == "body":
                return

    def handle_endtag(self, name: str) -> None:
        if self.line is not None:
            self.line.tags += 1
        else:
            self.pending += 1
        for i in range(len(self.stack) - 1, -1, -1) if self.open[name] else ():
            e = self.stack[i]
            if e.name == name:
                self.doubtful.discard(e.key)
                if name in BLOCK or e.kind:
                    self._drop(i)
                    self._cut()
                else:
                    self._drop(i, i + 1)
                return
            if name not in BLOCK and e.name in BLOCK:
                return  # a stray end of an inline element doesn't end the block around it
        if name == "p" or name in BLOCK:
            self._cut()

    def handle_data(self, data: str) -> None:
        if self.line is None and not data.strip():
            return
        line = self.line or self._current()
        line.pieces.append(data)
        if self.stack and self.stack[-1].linked:
            line.links += len(data)


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing with a kernel of 3 sigma either side, renormalised at both ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-((np.arange(-reach, reach + 1) / sigma) ** 2) / 2)
    n, cut = len(values), slice(reach, reach + len(values))
    weights = np.convolve(np.ones(n), kernel)[cut]
    return (np.convolve(values, kernel)[cut] / weights).tolist()


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.9) -> str:
    """The main text of one page.

    ``share`` is the part of the content cluster's characters that its core holds at least; it decides which short lines
    come along, never whether a line of the cluster, a heading or a paragraph does.
    Null, empty and text-free pages give an empty text; plain text without tags is its own content.
    """
    if not html:
        return ""
    parser = PageLines()
    parser.feed(html)
    parser.close()
    if parser.doubtful:
        parser = PageLines(frozenset(parser.doubtful))  # keys are the same, as they count start tags
        parser.feed(html)
        parser.close()
    lines = [(x, " ".join("".join(x.pieces).split())) for x in parser.lines]
    lines = [(x, text) for x, text in lines if text]
    if not lines:
        return ""
    own = [len(text) / max(1, x.tags) for x, text in lines]
    ratios = smoothed(own, sigma)
    mean = sum(ratios) / len(ratios)
    threshold = min(mean, math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)))
    kept = [x.of.kept and not (x.of.listed and not x.of.region and x.links >= 0.9 * len(text)) for x, text in lines]
    content = [i for i, r in enumerate(ratios) if r >= threshold and kept[i]] or [i for i, k in enumerate(kept) if k]

    def held(content: list[int]) -> tuple[list[int], int]:
        """Characters of the content in each element, and in all."""
        out = [0] * len(parser.around)
        for i in content:
            out[lines[i][0].of.key] += len(lines[i][1])
        for key in range(len(out) - 1, 0, -1):
            out[parser.around[key]] += out[key]
        return out, out[0]

    inside, total = held(content)
    named = any(k and x.of.region and not x.of.soft for (x, _), k in zip(lines, kept, strict=True))
    firm = lambda x: not x.of.soft or not named and 2 * inside[x.of.soft] >= total
    kept = [k and firm(x) for (x, _), k in zip(lines, kept, strict=True)]
    content = [i for i in content if kept[i]] or [i for i, k in enumerate(kept) if k]
    if not content:
        return ""
    inside, total = held(content)
    # elements that hold so much lie in one another, the innermost has the greatest key
    core = innermost = max(key for key, n in enumerate(inside) if n >= share * total)
    regions = {x.of.region for x, _ in lines if x.of.region}
    while core and core not in regions:
        core = parser.around[core]
    if not core:
        # a single paragraph may hold the cluster; its title and short neighbours lie in the container around it
        core = innermost
        while core and parser.names[core] not in CONTAINERS:
            core = parser.around[core]
    last = list(range(len(parser.around)))
    for key in range(len(last) - 1, 0, -1):
        last[parser.around[key]] = max(last[parser.around[key]], last[key])
    cluster = set(content)

    def belongs(i: int) -> bool:
        x, text = lines[i]
        if core <= x.of.key <= last[core]:
            return True
        if named and not x.of.region:
            return False  # outside all articles of a page that has one
        key = x.of.key
        while key and parser.names[key] not in BLOCK:
            key = parser.around[key]
        # a line's neighbours may have lifted it into the cluster; its own ratio must be as high, that of a short paragraph at least 1
        least = 0.0 if parser.names[key] in HEADING else 1.0 if parser.names[key] in PROSE else math.inf
        return 2 * x.links < len(text) and own[i] >= min(least, threshold if i in cluster else math.inf)

    return " ".join(text for i, (_, text) in enumerate(lines) if kept[i] and belongs(i))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars for every row of ``pages``; no row is dropped, repeated rows repeat.

    Pages are independent, so nothing is shuffled; memory is bounded by one Arrow batch and the page in hand.
    """
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars bigint"

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [main_text(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    [*keep, "text", "n_chars"],
                )

    return pages.select(*keep, F.col(html).alias("__html")).mapInArrow(on_partition, schema)
