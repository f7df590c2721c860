"""Main text of web pages by text-to-tag ratios (after Weninger, Hsu and Han, 2010).

The standard library's parser streams a page's events. Block tags cut its text
into lines; a line's ratio is its characters outside links over its tags. The
ratios are smoothed with a Gaussian, lines above a threshold form clusters, and
a cluster selects the region it stands in: the article or main element around
it, or else the smallest element that holds most of the clustered text. A
region gives all its lines but those of elements that are no article text by
their tag, role, id or class (menus, asides, forms, adverts, comments, ...), so
a short paragraph between long ones stays. What an id or class says counts
against an element only as long as the clusters do not say otherwise: one that
holds most of the clustered text of a page is the article, whatever its name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEED = 1 << 16
SIGMA, THRESHOLD, MOST = 1.0, 0.5, 0.7

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark nobr picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
#: Elements whose text is never article text.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input map math menu nav noscript object option script select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
#: Words in an id or class that mark such an element; those that begin with ``advert`` too.
NAMES = frozenset(
    """ad ads banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies disqus footer gdpr
    hidden login masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager
    pagination popup promo promos related replies respond share sharing sidebar signup social sponsor sponsored
    subscribe taboola toolbar widget widgets""".split()
)
#: Elements that hold an article as a whole, unless they are a reader's comment.
WHOLE = frozenset(("html", "body", "main", "article"))
COMMENTS = frozenset(("comment", "comments", "disqus", "replies", "respond"))
#: Tags that the next one of their kind closes.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}
}
SCOPES = frozenset(("ul", "ol", "dl", "table", "select", "article", "main", "section", "div", "body"))


@dataclass
class Line:
    text: str
    tags: int
    link_chars: int
    node: int


@dataclass
class Node:
    tag: str
    parent: int
    #: Whether it or an element around it is no article text by its tag or role, and whether its own id or class says so.
    dropped: bool
    named: bool = False
    whole: bool = False


class LineParser(HTMLParser):
    """Cuts a page into lines and notes the element that each stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.nodes = [Node("", -1, False)]
        self.stack = [0]
        self.open: Counter = Counter()
        self.pieces: list[str] = []
        self.tags = self.link_chars = self.links = 0
        self.ending = False

    def cut(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            at = self.stack[-1]
            self.lines.append(Line(text, self.tags, self.link_chars, at))
            self.tags = 0
        self.pieces, self.link_chars = [], 0

    def leave(self, depth: int) -> None:
        self.cut()
        self.open.subtract(self.nodes[n].tag for n in self.stack[depth:])
        del self.stack[depth:]
        self.links = 0

    def is_dropped(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Whether the element is no article text by its tag, role or style."""
        found = {k: v or "" for k, v in attrs}
        if tag in WHOLE:
            return False
        if tag in DROPPED or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
            return True
        return tag == "header" and not self.nodes[self.stack[-1]].whole or bool(re.search(r"display\s*:\s*none", found.get("style", "")))

    def is_named(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Whether the element's id or class says that it is no article text."""
        found = {k: v or "" for k, v in attrs}
        words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{found.get('id', '')} {found.get('class', '')}").lower()))
        if tag in WHOLE:
            return bool(words & COMMENTS) and tag == "article"
        if "header" in words and not self.nodes[self.stack[-1]].whole:
            return True
        return bool(words & NAMES) or any(w.startswith("advert") for w in words)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.pieces.append("\n")
            return
        if tag == "a":
            self.links = 1
        if tag in INLINE and not self.is_dropped(tag, attrs) and not self.is_named(tag, attrs):
            return
        if tag not in HEAD_ONLY and tag != "head" and self.nodes[self.stack[-1]].tag == "head":
            self.leave(len(self.stack) - 1)
        if tag not in INLINE:
            self.cut()
            if self.nodes[self.stack[-1]].tag == "p":
                self.leave(len(self.stack) - 1)
            for depth in range(len(self.stack) - 1, 0, -1):
                open_tag = self.nodes[self.stack[depth]].tag
                if open_tag in CLOSED_BY.get(tag, ()):
                    self.leave(depth)
                    break
                if open_tag in SCOPES:
                    break
        else:
            self.cut()  # an inline advert or the like
        if tag in VOID:
            return
        above = self.nodes[self.stack[-1]]
        dropped, named = above.dropped or self.is_dropped(tag, attrs), self.is_named(tag, attrs)
        self.nodes.append(Node(tag, self.stack[-1], dropped, named, not dropped and not named and tag in ("article", "main") or above.whole))
        self.stack.append(len(self.nodes) - 1)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag in INLINE:
            self.handle_starttag(tag, attrs)
            if tag == "a":
                self.links = 0
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = 0
        for depth in range(len(self.stack) - 1, 0, -1) if self.open[tag] > 0 else ():
            if self.nodes[self.stack[depth]].tag == tag:
                self.leave(depth)
                return
        if tag not in INLINE and tag != "br":
            self.cut()

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        if self.links:
            self.link_chars += len(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 and self.ending else end

    def run(self, html: str) -> list[Line]:
        for begin in range(0, len(html), FEED):
            self.feed(html[begin : begin + FEED])
        self.ending = True
        self.close()
        self.cut()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios, each the Gaussian mean of its neighbourhood; at the ends of what there is of it."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]
    return np.convolve(ratios, kernel)[reach:-reach] / weight


def clusters(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs (begin, end) of true flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


@dataclass
class Page:
    text: str = ""
    #: Runs (begin, end) of the lines of high ratio, and the numbers of the lines that make up the text.
    clusters: list[tuple[int, int]] = field(default_factory=list)
    kept: list[int] = field(default_factory=list)
    n_lines: int = 0


def ratios(lines: list[Line]) -> np.ndarray:
    """Of each line its characters outside links over its tags."""
    return np.array([max(0, len(x.text) - x.link_chars) / max(1, x.tags) for x in lines], float)


def clustered(values: np.ndarray, live: np.ndarray) -> np.ndarray:
    """The live lines whose smoothed ratio is above the threshold; those of the highest ratio if there are none."""
    smooth = smoothed(np.where(live, values, 0))
    content = live & (smooth > THRESHOLD * smooth[live].std()) & (values > 0)
    return content if content.any() else live & (values == values[live].max())


def main_text(html: str, ratios_of=ratios) -> Page:
    """The main text of one page."""
    parser = LineParser()
    lines = parser.run(html)
    nodes, of = parser.nodes, np.array([x.node for x in lines], np.int64)
    parent = [n.parent for n in nodes]
    values = ratios_of(lines)

    def mass(content: np.ndarray) -> list[int]:
        """Characters of the clustered lines in each element; an element comes before what it holds."""
        found = [0] * len(nodes)
        for i in np.flatnonzero(content):
            found[of[i]] += len(lines[i].text)
        for n in range(len(nodes) - 1, 0, -1):
            found[parent[n]] += found[n]
        return found

    # an element is not judged by its name if it holds most of the clustered text and no article or main element has its own
    kept = np.array([not nodes[n].dropped for n in of], bool)
    if not kept.any():
        return Page(n_lines=len(lines))
    held = mass(clustered(values, kept))
    plain, named = [False] * len(nodes), [False] * len(nodes)  # within an article or main element; within an element with a telling name
    for n in range(1, len(nodes)):
        named[n] = named[parent[n]] or nodes[n].named
        plain[n] = plain[parent[n]] or nodes[n].whole and not named[n]
    article = any(plain[n] and not plain[parent[n]] and held[n] > 0 for n in range(1, len(nodes)))
    gone = [False] * len(nodes)
    for n in range(1, len(nodes)):
        gone[n] = gone[parent[n]] or nodes[n].dropped or nodes[n].named and (article or held[n] < MOST * held[0])

    live = np.array([not gone[n] for n in of], bool)
    if not live.any():
        return Page(n_lines=len(lines))
    content = clustered(values, live)
    held = mass(content)
    holder = [0] * len(nodes)  # the outermost article or main element around each element
    for n in range(1, len(nodes)):
        holder[n] = holder[parent[n]] or (n if nodes[n].whole else 0)
    holders = {holder[of[i]] for i in np.flatnonzero(content)} - {0}
    if sum(held[n] for n in holders) >= 0.5 * held[0]:
        chosen = [i for i in range(len(lines)) if live[i] and holder[of[i]] in holders]
    else:
        region = 0
        for n in range(1, len(nodes)):
            if parent[n] == region and held[n] >= MOST * held[0] and nodes[n].tag != "p":
                region = n
        within = [n == region for n in range(len(nodes))]
        for n in range(1, len(nodes)):
            within[n] = within[n] or within[parent[n]]
        chosen = [i for i in range(len(lines)) if live[i] and within[of[i]]]
    return Page("\n".join(lines[i].text for i in chosen), clusters(content), chosen, len(lines))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines and n_clusters of every row of ``pages`` (page_id, url, html).

    Null and empty pages have an empty text, as have pages of which nothing is
    article text. A page is parsed whole, however long. Repeated rows give
    repeated rows; null ids and URLs pass through; other columns are not read.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                found = [main_text(x.as_py() or "") for x in batch.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page_id"), batch.column("url"),
                        pa.array([x.text for x in found], pa.string()), pa.array([len(x.text) for x in found], pa.int64()),
                        pa.array([x.n_lines for x in found], pa.int64()), pa.array([len(x.clusters) for x in found], pa.int64()),
                    ],
                    ["page_id", "url", "text", "n_chars", "n_lines", "n_clusters"],
                )

    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_lines long, n_clusters long"
    )
