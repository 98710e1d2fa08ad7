"""Main text of HTML pages by text-to-tag ratio.

The standard library's parser streams its events; they are cut into lines at block elements.  A line's ratio is its number of characters
outside links over the tags that it took.  Ratios are smoothed with a Gaussian and lines above a threshold, the smoothed mean times
``SHARE``, form clusters; the cluster with the most text marks the content region.  The region is completed to whole elements: to the
``article`` or ``main`` that holds most of the cluster or, where there is none, to the innermost container (``CONTAINERS``; never a single
paragraph) that holds the cluster's text up to ``LOSS`` of it, and from there to the containers around it as long as what they add has
``CONTENT_RATIO`` characters a tag; short paragraphs of an article so aren't lost to the threshold.

What a page says of an element is a hint that its ratios confirm or not.  Scripts, styles, controls, ``nav`` and ``footer`` give no lines.
Elements are suspects by tag (``aside``, ``form``), role or name.  A name of hints only, like ``site-footer`` or ``comments``, drops the element; a
name that has a hint among other words, like ``related-work``, drops it only where links are ``LINKS`` of its text or its own ratio is under
``CONTENT_RATIO``; neither drops what holds half of the page's text.  Of a header only headings count, and none of the site's, which lies directly
in the body or holds a menu.

Text.  Character references are decoded, white space inside a block is one space, blocks are trimmed, empty ones left out, the rest
joined by a line feed in page order.  ``br`` inside a block is white space.

Scale.  A page is read once, with sums over elements in the order in which they open, so the work is linear in its size, however deep
or broken its nesting.  Pages are extracted where they are read, without a shuffle.

Edge cases.  Null and empty pages, and pages without content lines, give an empty text.  Unclosed and stray tags are tolerated: an end
tag closes the elements opened inside its own; ``p`` and ``li`` close their predecessors; a malformed declaration is a comment.  Of
clusters with equally much text the first counts.  Repeated rows are extracted each.  An empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from rategrid.llm.common import appended, small_batches, with_columns

SIGMA = 1.0
SHARE = 0.6
LOSS = 0.1
CONTENT_RATIO = 20
LINKS = 0.3

#: HTML elements by role, and words of class names and ids.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("audio button canvas datalist dialog footer head iframe nav noscript object script select style svg template textarea title video".split())
CONTENT = frozenset(("article", "main"))
CONTAINERS = frozenset("body center div html section table tbody td th tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
SUSPECTS = frozenset("aside form menu".split())
ROLES = frozenset("alert alertdialog complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HINTS = frozenset(
    "ad ads adsbygoogle advert advertisement adverts advertising aside breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "disqus footer gdpr menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted "
    "promotion related respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
HEADERS = frozenset("banner header masthead".split())
NEUTRAL = frozenset("area bar block bottom box buttons container content global group inner item items left links list main outer page reader right section site thread top wrap wrapper".split())
_PIECES = re.compile(r"[^a-z]+")
OPEN, WEAK, STRONG, HEADER, HIDDEN = range(5)


def kind(tag: str, attrs: list) -> int:
    """What tag, role and names say of an element."""
    found = STRONG if tag in SUSPECTS else HEADER if tag == "header" else OPEN
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return HIDDEN
        if not value or tag in CONTENT or tag in ("body", "html"):
            continue
        if name == "role":
            role = value.strip().lower()
            found = max(found, STRONG if role in ROLES else HEADER if role == "banner" else OPEN)
        elif name in ("class", "id"):
            for token in value.lower().split():
                pieces = [x for x in _PIECES.split(token) if x]
                hints = [x for x in pieces if x in HINTS]
                if hints:
                    found = max(found, STRONG if all(x in HINTS or x in NEUTRAL for x in pieces) else WEAK)
                elif tag not in HEADINGS and any(x in HEADERS for x in pieces):
                    found = max(found, HEADER)
    return found


class Lines(HTMLParser):
    """Cuts a page into lines and numbers its elements in the order in which they open; number 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []
        self.open: Counter = Counter()  # open elements by tag
        self.tag, self.parent, self.kinds = ["html"], [0], [OPEN]
        self.never = 0
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags, characters in links, element
        self.text: list[str] = []
        self.linked = self.tags = 0

    def cut(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, min(self.linked, len(text)), self.stack[-1][1] if self.stack else 0))
                self.tags = 0
            self.text.clear()
            self.linked = 0

    def updatepos(self, i, j):  # line numbers aren't needed
        return j

    def parse_marked_section(self, i, report=1):  # HTML has none: what looks like one is a comment
        return self.parse_bogus_comment(i)

    def pop(self) -> None:
        tag, _ = self.stack.pop()
        self.open[tag] -= 1
        self.never -= tag in NEVER

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self.close_open(tag, ("ul", "ol", "dl", "table", "menu", "select"))
            self.close_open("p", ("div", "article", "section", "td", "li", "blockquote", "main", "aside", "form"))
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        self.stack.append((tag, len(self.tag)))
        self.open[tag] += 1
        self.never += tag in NEVER
        self.parent.append(self.stack[-2][1] if len(self.stack) > 1 else 0)
        self.tag.append(tag)
        self.kinds.append(kind(tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:  # of a block, the slash means nothing in HTML
            self.handle_endtag(tag)

    def close_open(self, tag: str, within: tuple) -> None:
        """Closes the nearest open ``tag``, if no element of ``within`` was opened after it."""
        if self.open[tag] <= 0:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k][0] in within:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        elif tag == "br":
            self.text.append(" ")
        if self.open[tag] <= 0:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            own = self.stack[k][0]
            if own == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if own in BLOCKS and tag not in BLOCKS:
                return  # an inline end tag doesn't close blocks

    def handle_data(self, data):
        if not self.never:
            self.text.append(data)
            if self.open["a"] > 0:
                self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; weights are renewed at the ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    whole = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / whole


class Page:
    """Lines of a page as arrays, and sums of them over its elements."""

    def __init__(self, parser: Lines):
        self.tag, self.parent, self.kinds = parser.tag, np.array(parser.parent), np.array(parser.kinds)
        self.texts = [x[0] for x in parser.lines]
        self.size, self.tags, self.linked, self.element = np.array([(len(t), max(1, n), k, e) for t, n, k, e in parser.lines], np.int64).reshape(-1, 4).T
        n = len(self.tag)
        self.last = np.arange(n)  # the last element opened inside one
        for e, up in zip(range(n - 1, 0, -1), self.parent[:0:-1].tolist()):
            self.last[up] = max(self.last[up], self.last[e])

    def sums(self, of_lines: np.ndarray) -> np.ndarray:
        """Of each element, the sum over the lines inside it: those of the elements from its number to that of the last one in it."""
        before = np.concatenate([[0], np.cumsum(np.bincount(self.element, of_lines, len(self.tag)))])
        return before[self.last + 1] - before[np.arange(len(self.tag))]

    def kept(self) -> np.ndarray:
        """Which lines don't lie in an element that hints and ratios drop."""
        size, linked, tags = self.sums(self.size), self.sums(self.linked), self.sums(self.tags)
        menus = np.bincount(np.arange(len(self.tag)), [t == "nav" for t in self.tag]).cumsum()
        gone, header = np.zeros(len(self.tag), bool), np.zeros(len(self.tag), bool)
        for e, (k, up, last) in enumerate(zip(self.kinds.tolist(), self.parent.tolist(), self.last.tolist())):
            gone[e], header[e] = gone[up], header[up]
            if k == OPEN or gone[e]:
                continue
            links, loose = linked[e] > LINKS * size[e], size[e] - linked[e] < CONTENT_RATIO * tags[e]
            if k == HEADER:
                site = self.tag[up] in ("body", "html") or menus[last] > menus[e] or links
                gone[e], header[e] = site and 2 * size[e] < size[0], 2 * size[e] < size[0]
            else:
                gone[e] = k == HIDDEN or 2 * size[e] < size[0] and (k == STRONG or links or loose)
        # a line in a header counts if it is, or lies in, a heading
        heading = np.zeros(len(self.tag), bool)
        for e, up in enumerate(self.parent.tolist()):
            heading[e] = heading[up] and e > 0 or self.tag[e] in HEADINGS
        return ~gone[self.element] & (~header[self.element] | heading[self.element])

    def region(self) -> tuple[int, int]:
        """The numbers of the first and last element of the content region."""
        ratios = smoothed((self.size - self.linked) / self.tags)
        above = np.concatenate([[False], ratios >= SHARE * ratios.mean(), [False]])
        starts, ends = np.flatnonzero(above[1:] & ~above[:-1]), np.flatnonzero(above[:-1] & ~above[1:])
        runs = [int(self.size[a:z].sum()) for a, z in zip(starts, ends)]
        best = int(np.argmax(runs))
        cluster = np.zeros(len(self.size))
        cluster[starts[best] : ends[best]] = 1
        held, most = self.sums(cluster * self.size), runs[best]
        marked = [e for e, t in enumerate(self.tag) if t in CONTENT and held[e]]
        if marked:
            e = max(marked, key=lambda e: (held[e], -e))
            return e, int(self.last[e])
        around = [e for e, t in enumerate(self.tag) if t in CONTAINERS and held[e] >= (1 - LOSS) * most]
        inside = around[-1]  # the page holds everything; of the others the innermost opened last
        size, tags = self.sums(self.size), self.sums(self.tags)
        outer = int(self.parent[inside])
        while inside:
            if self.tag[outer] in CONTAINERS:
                if size[outer] - size[inside] < CONTENT_RATIO * (tags[outer] - tags[inside]):
                    break
                inside = outer
            if outer == 0:
                break
            outer = int(self.parent[outer])
        return inside, int(self.last[inside])

    def without(self, keep: np.ndarray) -> None:
        self.texts = [t for t, k in zip(self.texts, keep.tolist()) if k]
        self.size, self.tags, self.linked, self.element = (x[keep] for x in (self.size, self.tags, self.linked, self.element))


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    page = Page(parser)
    page.without(page.kept())
    if not page.texts:
        return ""
    first, last = page.region()
    return "\n".join(t for t, e in zip(page.texts, page.element.tolist()) if first <= e <= last)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    own = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(frames):
        for batch in frames:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            done = appended(batch.select([0, 1]), text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))
            yield done

    return small_batches(own).mapInArrow(run, with_columns(own.drop("html").schema, text=StringType(), n_chars=LongType()))
