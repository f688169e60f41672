"""HTML extraction: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "tfoot", "thead", "title", "tr", "ul",
}
#: Elements whose whole content is never main text.
DROPPED = {
    "aside", "audio", "button", "canvas", "datalist", "dialog", "embed", "footer", "form", "head", "iframe", "input", "label", "map", "math", "menu", "nav", "noscript", "object",
    "option", "script", "search", "select", "style", "svg", "template", "textarea", "title", "video",
}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "status", "toolbar"}
#: Parts of class and id names that mark what is not the article.
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adbox", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus",
    "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pagination", "pager", "popup",
    "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Marks that also name threads, which may be longer than their article.
THREADS = {"comment", "comments", "disqus", "replies", "respond"}
#: Class names that tell a state of the page, not what the element is.
_STATE = re.compile(r"(?i:(?:has|no|with|without)[-_].*|.*[-_](?:enabled|disabled)|comments?[-_](?:open|closed))")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Line:
    """A block of text: its words, the tags and link characters in it, the innermost element
    around it, and the marks around all of it (``chain``: an element; ``also``: names that
    stand in every branch below it)."""

    text: str
    tags: int
    linked: int
    dropped: bool
    at: int
    chain: int = -1
    also: frozenset[str] = frozenset()
    marked: bool = False


@dataclass
class Element:
    """An open or closed element. Elements are numbered as they open, so what lies inside
    one has the numbers up to ``last``. ``own``: marks of the element that no element around
    it has; ``chain``: the nearest element with such marks, itself included."""

    tag: str
    parent: int
    never: bool
    own: frozenset[str]
    chain: int
    heading: bool
    header: bool
    last: int = -1


def _never(tag: str, attrs: list, inside: bool) -> bool:
    """Whether an element with its content is not main text whatever it holds."""
    if tag in DROPPED:
        return True
    own = {k: v or "" for k, v in attrs}
    if tag == "header" and not inside:
        return True
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(own.get("style", "")):
        return True
    return own.get("role", "").lower() in ROLES


def _parts(name: str) -> set[str]:
    return {p.lower() for p in _PARTS.findall(name)}


def _marks(tag: str, attrs: list, inside: bool) -> frozenset[str]:
    """The class and id names that mark an element as not the article."""
    if tag in ("html", "body", "main") or (tag == "article" and not inside) or tag == "header":
        return frozenset()
    names = [n for k, v in attrs if k in ("class", "id") for n in (v or "").split()]
    return frozenset(n for n in names if _parts(n) & MARKS and not _STATE.fullmatch(n))


class Reader(HTMLParser):
    """Turns parser events into lines. Unclosed and crossed tags are closed by what follows.
    ``trusted``: marks that are not heeded. Every event costs the same however deep the
    page is nested: what is open is counted, and elements point to their parents."""

    def __init__(self, trusted: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.trusted = trusted
        self.elements: list[Element] = []
        self.stack: list[int] = []
        self.places: dict[str, list[int]] = {}  # tag -> places on the stack
        self.blocks: list[int] = []  # places of block elements
        self.open_marks: dict[str, int] = {}
        self.lines: list[Line] = []
        self.parts: list[tuple[str, bool, int]] = []  # text, never, chain
        self.tags = self.linked = 0

    def is_open(self, *tags: str) -> bool:
        return any(self.places.get(t) for t in tags)

    def add(self, data: str) -> None:
        top = self.elements[self.stack[-1]] if self.stack else None
        self.parts.append((data, top.never, top.chain) if top else (data, False, -1))

    def flush(self) -> None:
        """Ends a line. Text of dropped elements inside a block does not reach it; a line
        that is dropped for its marks only keeps them."""
        kept = " ".join("".join(t for t, d, c in self.parts if not d and c < 0).split())
        marked = "" if kept else " ".join("".join(t for t, d, _ in self.parts if not d).split())
        text = kept or marked or " ".join("".join(t for t, _, _ in self.parts).split())
        if text:
            at = self.stack[-1] if self.stack else -1
            chain, also = self.common([c for t, d, c in self.parts if not d and t.strip()]) if marked else (-1, frozenset())
            self.lines.append(Line(text, self.tags, self.linked, not kept, at, chain, also, bool(marked) and (chain >= 0 or bool(also))))
            self.tags = 0
        self.parts, self.linked = [], 0

    def up(self, chain: int) -> int:
        """The next marked element around a marked one."""
        parent = self.elements[chain].parent
        return self.elements[parent].chain if parent >= 0 else -1

    def common(self, chains: list[int]) -> tuple[int, frozenset[str]]:
        """Marks around all parts of a line: the innermost marked element around them, and
        names that every part has in a branch of its own."""
        low, high = min(chains), max(chains)
        if low == high:
            return low, frozenset()
        top = low
        while top >= 0 and high > self.inner(top):
            top = self.up(top)
        counts: dict[int, int] = {}
        for c in chains:
            counts[c] = counts.get(c, 0) + 1
        covered, seen = {}, set()
        for c in list(counts):  # every marked element between the parts and the top once
            while c > top and c not in seen:
                seen.add(c)
                c = self.up(c)
        for c in sorted(seen, reverse=True):
            n = counts.get(c, 0)
            for m in self.elements[c].own:
                covered[m] = covered.get(m, 0) + n
            counts[self.up(c)] = counts.get(self.up(c), 0) + n
        return top, frozenset(m for m, n in covered.items() if n == len(chains))

    def inner(self, n: int) -> int:
        """The last element inside element ``n`` so far."""
        last = self.elements[n].last
        return len(self.elements) if last < 0 else last

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            self.close_implied(tag)
        elif tag in ("br", "td", "th", "option"):
            self.close_implied(tag)
            self.add(" ")
        self.tags += 1
        if tag in VOID:
            return
        inside = self.is_open("article", "main")
        parent = self.stack[-1] if self.stack else -1
        above = self.elements[parent] if self.stack else Element("", -1, False, frozenset(), -1, False, False)
        own = _marks(tag, attrs, inside) - self.trusted
        header = above.header or tag == "header"
        if inside and (tag == "header" or own and all(_parts(n) & MARKS == {"header"} for n in own)):
            header, own = True, frozenset()
        own = frozenset(m for m in own if not self.open_marks.get(m))
        n = len(self.elements)
        self.elements.append(Element(tag, parent, above.never or _never(tag, attrs, inside), own, n if own else above.chain, above.heading or tag in HEADINGS, header))
        for m in own:
            self.open_marks[m] = self.open_marks.get(m, 0) + 1
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(n)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def close(self) -> None:
        super().close()
        self.flush()
        self.close_from(0)

    def close_from(self, place: int) -> None:
        """Closes the elements from a place of the stack up."""
        while len(self.stack) > place:
            done = self.elements[self.stack.pop()]
            done.last = len(self.elements) - 1
            self.places[done.tag].pop()
            if done.tag in BLOCKS:
                self.blocks.pop()
            for m in done.own:
                self.open_marks[m] -= 1

    def nearest(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close_implied(self, tag: str) -> None:
        """A block ends an open paragraph; list items, rows and cells end the one before."""
        ends = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}.get(tag, set())
        bounds = {"ul", "ol", "dl", "menu"} if tag in ("li", "dt", "dd") else {"table"} if tag in ("tr", "td", "th") else set()
        paragraph = self.nearest(["p"]) if tag in BLOCKS else -1
        if ends:
            found = max(self.nearest(ends), paragraph)
            stop = self.nearest(bounds)
        else:
            found, stop = paragraph, self.blocks[-1] - 1 if self.blocks else -1
        if found > stop:
            self.close_from(found)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        elif tag in ("td", "th"):
            self.add(" ")
        self.tags += 1
        if self.places.get(tag):
            self.close_from(self.places[tag][-1])

    def handle_data(self, data):
        self.add(data)
        if self.is_open("a"):
            self.linked += len(data)

    def sums(self, lines: list[Line]) -> list[int]:
        """Characters of ``lines`` inside each element."""
        out = [0] * len(self.elements)
        for x in lines:
            if x.at >= 0:
                out[x.at] += len(x.text)
        for n in range(len(out) - 1, -1, -1):
            if self.elements[n].parent >= 0:
                out[self.elements[n].parent] += out[n]
        return out

    def inside(self, line: Line, n: int) -> bool:
        return n <= line.at <= self.elements[n].last


def read_lines(html: str, trusted: frozenset[str] = frozenset()) -> Reader:
    reader = Reader(trusted)
    reader.feed(html)
    reader.close()
    return reader


def wrappers(reader: Reader, good: np.ndarray) -> frozenset[str]:
    """Marks that do not tell what is not the article on this page, since they hold it: those
    around a main element, around most of the content characters, or around the article if
    it outweighs the unmarked content. Names of threads count only around a main element or
    where nothing is unmarked."""
    elements = reader.elements
    lines = [x for x, g in zip(reader.lines, good, strict=True) if g and (not x.dropped or x.marked)]
    total = sum(len(x.text) for x in lines)
    plain = sum(len(x.text) for x in lines if not x.dropped)
    weight: dict[str, int] = {}
    chained = [0] * len(elements)
    for x in lines:
        if x.chain >= 0:
            chained[x.chain] += len(x.text)
        for m in x.also:
            weight[m] = weight.get(m, 0) + len(x.text)
    for n in range(len(elements) - 1, -1, -1):
        if elements[n].own:
            for m in elements[n].own:
                weight[m] = weight.get(m, 0) + chained[n]
            if (above := reader.up(n)) >= 0:
                chained[above] += chained[n]

    def around(n: int) -> set[str]:
        names, chain = set(), elements[n].chain
        while chain >= 0:
            names |= elements[chain].own
            chain = reader.up(chain)
        return names

    held = {m for m, w in weight.items() if 2 * w > total}
    inner = reader.sums(lines)
    mains = [n for n, e in enumerate(elements) if e.tag == "main" and inner[n]]
    found = around(mains[-1]) if mains else set()  # mains inside each other share what is around
    for n in mains[:-1]:
        found |= elements[n].own if elements[mains[-1]].parent >= n and mains[-1] <= elements[n].last else around(n)
    articles = [n for n, e in enumerate(elements) if e.tag == "article" and inner[n]]
    if articles and inner[best := max(articles, key=lambda n: (inner[n], -n))] > plain:
        held |= around(best)
    if any(not x.dropped for x in reader.lines):
        held = {m for m in held if not _parts(m) & THREADS}
    return frozenset(found | held)


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights are those of the lines that exist."""
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    mid = slice(reach, reach + len(values))
    return np.convolve(values, kernel)[mid] / np.convolve(np.ones(len(values)), kernel)[mid]


def content_lines(lines: list[Line], sigma: float) -> np.ndarray:
    """Which lines belong to content: their smoothed text-to-tag ratio lies in the upper of
    two clusters, found by moving the threshold to the middle of the cluster means."""
    ratio = np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines], dtype=float)
    value = smoothed(ratio, sigma)
    cut = value.mean()
    for _ in range(50):
        low, high = value[value < cut], value[value >= cut]
        if not len(low) or not len(high):
            break
        new = (low.mean() + high.mean()) / 2
        if new == cut:
            break
        cut = new
    return value >= cut


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Main text of a page: blocks in page order, one newline between them.

    The content lines choose the region: the article (or main element) that holds most of
    their characters with the articles beside it that hold content lines, else the innermost
    element that holds all of them; and what lies between the region and the last h1 before
    it, if the region has none of its own. All of that region's text is returned but for
    elements that are marked as menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles or comments, and, where no article is marked, lines that are links
    only, unless they are headings or content lines. Class and id names mark an element
    only if they do not hold the article itself (see ``wrappers``); of a header inside an
    article the headings stay. The time is linear in the page, however it is nested.
    """
    reader = read_lines(html or "")
    good = content_lines(reader.lines, sigma) if reader.lines else np.zeros(0, dtype=bool)
    trusted: frozenset[str] = frozenset()
    while more := wrappers(reader, good):  # marks inside a wrapper show once it is trusted
        trusted |= more
        reader = read_lines(html or "", trusted)
        good = content_lines(reader.lines, sigma)
    elements = reader.elements
    live = [x for x in reader.lines if not x.dropped]
    if not live:
        return ""
    chosen = [x for x, g in zip(reader.lines, good, strict=True) if g and not x.dropped] or live
    inner = reader.sums(chosen)
    marked = [n for n, e in enumerate(elements) if inner[n] and e.tag in ("article", "main")]
    articles = [n for n in marked if elements[n].tag == "article"] or marked
    if articles:
        region = max(articles, key=lambda n: (inner[n], -n))
        beside = [n for n in articles if elements[n].parent == elements[region].parent and elements[n].tag == elements[region].tag]
        inside = _members(reader, beside)
        first, last = _lead(reader, live, beside[0], inside)
        kept = [x for k, x in enumerate(live) if first <= k < last or x.at in inside]
    else:
        content = {id(x) for x in chosen}
        # a link beside the content is content by smoothing only; one between its lines is
        own = [k for k, x in enumerate(live) if id(x) in content and not _is_link(x)] or [k for k, x in enumerate(live) if id(x) in content]
        region = _around(reader, [live[k].at for k in own])
        title = max((k for k in range(own[0]) if _in_h1(reader, live[k])), default=own[0])
        near = [(k, x) for k, x in enumerate(live) if title <= k < own[0] or region < 0 or reader.inside(x, region)]
        kept = [x for k, x in near if not _is_link(x) or _in_heading(reader, x) or id(x) in content and own[0] < k < own[-1]]
    kept = [x for x in kept if x.at < 0 or not elements[x.at].header or elements[x.at].heading]
    return "\n".join(x.text for x in kept)


def _members(reader: Reader, regions: list[int]) -> set[int]:
    """The elements inside any of the regions."""
    out: set[int] = set()
    for n in regions:
        if n not in out:
            out.update(range(n, reader.elements[n].last + 1))
    return out


def _around(reader: Reader, places: list[int]) -> int:
    """The innermost element around all places, -1 for the page."""
    low, high = min(places), max(places)
    while low >= 0 and high > reader.elements[low].last:
        low = reader.elements[low].parent
    return low


def _lead(reader: Reader, live: list[Line], region: int, inside: set[int]) -> tuple[int, int]:
    """First and last (exclusive) of the lines between an article's headline and the article,
    where the headline stands before it in the same main element, or under the same parent
    if there is none."""
    start = next(k for k, x in enumerate(live) if x.at in inside)
    if any(x.at in inside and _in_h1(reader, x) for x in live):
        return start, start
    scope = parent = reader.elements[region].parent
    while scope >= 0 and reader.elements[scope].tag != "main":
        scope = reader.elements[scope].parent
    scope = scope if scope >= 0 else parent
    titles = [k for k in range(start) if scope >= 0 and reader.inside(live[k], scope) and _in_h1(reader, live[k])]
    return (titles[-1], start) if titles else (start, start)


def _is_link(line: Line) -> bool:
    return line.linked >= 0.9 * len(line.text)


def _in_heading(reader: Reader, line: Line) -> bool:
    return line.at >= 0 and reader.elements[line.at].heading


def _in_h1(reader: Reader, line: Line) -> bool:
    n = line.at
    while n >= 0 and reader.elements[n].heading:
        if reader.elements[n].tag == "h1":
            return True
        n = reader.elements[n].parent
    return False


def extract(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Per row ``page_id, url, text, n_chars`` from the whole html; null or without main text:
    an empty text. Repeated rows stay repeated, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, sigma) for h in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
