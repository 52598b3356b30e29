"""Main text of web pages, from the events of the standard library's HTML parser.

Each block of text is a line; its text-to-tag ratio is its length over the tags met since the last block. The
ratios of a page are smoothed with a Gaussian kernel and split in two clusters by threshold; the lines of the
high cluster name the content region: the smallest container that holds most of their text, and from there its
parents, as long as what they add is unmarked text without lines that are links only, or has text of the high
cluster too. Everything in the region is kept, short lines too, but what is marked as a menu, header, footer,
sidebar, notice, advert, form, script, style or reader comment. Lines that are links only count as marked where
the region is the page itself or has grown over them, unless they lie between lines of the high cluster.

A name can hold a marking word and mean something else. What is marked is kept where it holds most of the text that could be
content (a form around the page, a wrapper), but for reader comments; inside an article a name with another word that names no part of
a page (related-work) marks only what isn't of the high cluster for the most part. Time is linear in the page: open elements
are found by their places, and sums over nested elements go once from the leaves up.

Cases: null or empty html gives an empty text, as does a page whose whole text is marked; broken markup is read
as the parser gives it, with implied ends for paragraphs and list items; ties in the clusters go to content;
repeated rows give repeated results; columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# Elements that begin and end a block, that have no end, and whose text is never content.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset(
    "aside button canvas datalist dialog embed footer head iframe input menu nav noscript object script search select "
    "style svg template textarea title audio video map".split()
)
CONTAINERS = frozenset("article body div main section td".split())
#: An element of the key ends the elements of the value that are still open directly below.
IMPLIED = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
# Words in class, id and role that mark an element as something else than content.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs comment comments commentlist complementary "
    "contentinfo cookie cookies consent disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices "
    "notification overlay pagination popup promo promotion promoted related replies reply respond share sharing sidebar sidenav skip social "
    "sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
# Words that make a name a condition of a wrapper, and those that mark reader comments.
STATES = frozenset("no not non has with without is open opened closed enabled disabled lazy on off free".split())
REMARKS = frozenset("comment comments commentlist disqus replies reply respond".split())
# Words for parts of a page, which say nothing about what a marked one holds.
PARTS = frozenset(
    "area article articles aside author bar big block blocks body bottom box button buttons card cards center center col column container content desktop div entry "
    "extra field fixed float footer form global group head header heading home html icon icons id image img inner input item items js l label large layout left level link links list "
    "lg m main md media meta middle mobile module modules more news outer page pages panel placeholder popular position post posts primary reader rectangle right row s section "
    "secondary sign signup site sky skyscraper slot small sm sticky stories story tag tags text tile title top unit units up user view wrap wrapper wrapping x xl zone".split()
)
_NAMES, _WORDS = re.compile(r"\S+"), re.compile(r"[a-z]+")


def marked(value: str) -> tuple[set[str], bool]:
    """The words that mark an element in a class, id or role, and whether each name that has some also has a word that is no part of a page."""
    found: set[str] = set()
    doubtful = True
    for name in _NAMES.findall(value.lower()):
        words = set(_WORDS.findall(name))
        if words & MARKS and not words & STATES:
            found |= words & MARKS
            doubtful &= bool(words - MARKS - PARTS)
    return found, doubtful and bool(found)


#: Standard deviation of the smoothing kernel, in lines, and its reach.
SIGMA, REACH = 1.0, 3
#: Share of the high cluster's text that the region holds.
MOST = 0.6


class _Open(NamedTuple):
    """An open element."""

    tag: str
    container: int
    noise: bool  # from here on
    mark: int
    linked: bool  # in a link
    inside: bool  # in an article or main element


class _Mark:
    def __init__(self, parent: int, remarks: bool, inside: bool, doubtful: bool) -> None:
        self.parent, self.remarks, self.inside, self.doubtful = parent, remarks, inside, doubtful and inside
        self.main = self.article = False  # it holds one
        self.size = 0


_NOTHING = _Open("", -1, False, -1, False, False)


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = {}  # by tag: where it is open
        self.open_blocks: list[int] = []  # where blocks are open, and where those are that aren't paragraphs
        self.open_firm: list[int] = []
        self.parents: list[tuple[int, str]] = []  # by container: parent, tag
        self.marks: list[_Mark] = []
        self.articles = 0  # articles and main elements outside of all marks
        self.blocks: list[tuple[list, int, int]] = []  # pieces of text (data, mark, in a link, inside an article), tags, container
        self.text: list[tuple[str, int, bool, bool]] = []
        self.tags = 0

    def flush(self) -> None:
        if self.text:
            self.blocks.append((self.text, self.tags, self.stack[-1].container if self.stack else -1))
            self.text, self.tags = [], 0

    def _push(self, x: _Open) -> None:
        at = len(self.stack)
        self.stack.append(x)
        self.places.setdefault(x.tag, []).append(at)
        if x.tag in BLOCKS:
            self.open_blocks.append(at)
            if x.tag != "p":
                self.open_firm.append(at)

    def _cut(self, at: int) -> None:
        """Close all elements from a place on."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.open_blocks.pop()
                if tag != "p":
                    self.open_firm.pop()

    def _last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.text.append((" ", -1, True, False))
        if tag in BLOCKS:
            self.flush()
            if ends := IMPLIED.get(tag):
                at, firm = max(map(self._last, ends)), self.open_blocks if tag == "p" else self.open_firm
                if at >= 0 and at >= (firm[-1] if firm else -1):
                    self._cut(at)
        if tag in VOID:
            return
        up = self.stack[-1] if self.stack else _NOTHING
        noise, mark, parent = up.noise, up.mark, up.container
        if not noise:
            noise = tag in NOISE or tag == "header" and not up.inside
        if not noise and tag not in ("html", "body", "article", "main"):
            noise = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
            names = [marked(v) for k, v in attrs if k in ("class", "id", "role") and v]
            words = set().union(*[x for x, _ in names])
            if words or tag == "form":
                self.marks.append(_Mark(mark, not words.isdisjoint(REMARKS), up.inside, tag != "form" and all(d for x, d in names if x)))
                mark = len(self.marks) - 1
        if not noise and tag in ("main", "article"):
            self.articles += mark < 0
            if mark >= 0:
                self.marks[mark].main |= tag == "main"
                self.marks[mark].article |= tag == "article"
        if tag in CONTAINERS:
            self.parents.append((parent, tag))
            parent = len(self.parents) - 1
        self._push(_Open(tag, parent, noise, mark, up.linked or tag == "a", up.inside or tag in ("article", "main")))

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        at = self._last(tag)
        if at >= 0 and (tag in BLOCKS or not self.open_blocks or self.open_blocks[-1] < at):  # an inline end does not close blocks
            self._cut(at)

    def handle_data(self, data):
        up = self.stack[-1] if self.stack else _NOTHING
        if not up.noise:
            self.text.append((data, up.mark, up.linked, up.inside))

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)  # <![...>: unknown keywords would end the parse

    def lines(self, html: str) -> list[tuple[str, int, int, bool, int]]:
        """Text, tags, container, links only, and doubtful mark (or -1) of each block, without what is surely marked."""
        self.feed(html)
        self.close()
        self.flush()
        marks, whole, held, remark = self.marks, 0, 0, []
        for x in marks:  # parents come before their children
            remark.append(x.remarks or x.parent >= 0 and remark[x.parent])
        for pieces, _, _ in self.blocks:
            for data, m, _, inside in pieces:
                n = len(data.strip())
                if m >= 0:
                    marks[m].size += n
                if m < 0 or not remark[m]:  # what could be content
                    whole += n
                    held += n * inside
        for x in reversed(marks):
            if x.parent >= 0:
                up = marks[x.parent]
                up.size, up.main, up.article = up.size + x.size, up.main or x.main, up.article or x.article
        gone, doubt = [False] * len(marks), [-1] * len(marks)
        for k, x in enumerate(marks):
            most = not x.remarks and (2 * x.size > held if x.inside else not self.articles and 2 * x.size > whole)
            wrapper = x.main or not self.articles and x.article or most
            gone[k] = not wrapper and not x.doubtful or x.parent >= 0 and gone[x.parent]
            doubt[k] = doubt[x.parent] if x.parent >= 0 and doubt[x.parent] >= 0 else k if x.doubtful and not wrapper else -1
        out, tags = [], 0
        for pieces, n, at in self.blocks:
            kept = [(data, link, m) for data, m, link, _ in pieces if m < 0 or not gone[m]]
            line, tags = " ".join("".join(x for x, _, _ in kept).split()), tags + n
            if line:
                first = next(m for x, _, m in kept if not x.isspace())
                out.append((line, tags, at, all(link or x.isspace() for x, link, _ in kept), doubt[first] if first >= 0 else -1))
                tags = 0
        return out


def smooth(ratios: list[float]) -> list[float]:
    from math import exp

    kernel = [exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-REACH, REACH + 1)]
    out = []
    for i in range(len(ratios)):
        num = den = 0.0
        for k, w in zip(range(i - REACH, i + REACH + 1), kernel, strict=True):
            if 0 <= k < len(ratios):
                num += w * ratios[k]
                den += w
        out.append(num / den)
    return out


def threshold(values: list[float]) -> float:
    """Midpoint of two clusters: the mean as a start, then the middle of the means on both sides until it stays; no higher than the highest value."""
    t = sum(values) / len(values)
    for _ in range(20):
        low, high = [v for v in values if v < t], [v for v in values if v >= t]
        if not low or not high:
            break
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return min(t, max(values))


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = _Page()
    lines = page.lines(html)
    if not lines:
        return ""
    ratios = smooth([len(t) / max(1, n) for t, n, *_ in lines])
    least = threshold(ratios)
    chosen = [r >= least for r in ratios]
    if any(x[4] >= 0 for x in lines):  # what is doubtful is content if most of its text is of the high cluster
        sizes: dict[int, list[int]] = {}
        for (t, _, _, link, m), c in zip(lines, chosen, strict=True):
            if m >= 0:
                size = sizes.setdefault(m, [0, 0])
                size[c and not link] += len(t)
        lines = [x for x in lines if x[4] < 0 or sizes[x[4]][1] >= sizes[x[4]][0]]
        if not lines:
            return ""
        ratios = smooth([len(t) / max(1, n) for t, n, *_ in lines])
        least = threshold(ratios)
        chosen = [r >= least for r in ratios]
    held = [0] * len(page.parents)
    whole = 0
    for (t, _, at, *_), c in zip(lines, chosen, strict=True):
        if c:
            whole += len(t)
            if at >= 0:
                held[at] += len(t)
    for k in range(len(held) - 1, -1, -1):  # parents come before their children
        if page.parents[k][0] >= 0:
            held[page.parents[k][0]] += held[k]
    region, ancestors = -1, set()
    for k, (parent, tag) in enumerate(page.parents):  # parents come before their children
        if parent == region and held[k] >= MOST * whole and held[k]:
            region = k
            ancestors.add(k)
            if tag in ("article", "main"):
                break
    found = region >= 0 and page.parents[region][1] in ("article", "main")
    chain = [region]
    while not found and chain[-1] >= 0:
        chain.append(page.parents[chain[-1]][0])
    # by container: the first of the region and its parents that it lies in; parents come before their children
    rank, top = {k: n for n, k in enumerate(chain)}, len(chain) if found else len(chain) - 1
    level = [0] * len(page.parents)
    for k, (parent, _) in enumerate(page.parents):
        level[k] = rank[k] if k in rank else level[parent] if parent >= 0 else top
    at_level = [level[at] if at >= 0 else top for _, _, at, *_ in lines]
    links = {n for n, x in zip(at_level, lines, strict=True) if x[3]}
    high = [i for i, (t, n, _, link, _) in enumerate(lines) if chosen[i] and not link and at_level[i] < len(chain) and len(t) / max(1, n) >= least]
    most = max((at_level[i] for i in high), default=0)
    while most + 1 < len(chain) and most + 1 not in links:
        most += 1
    inside = [i for i in range(len(lines)) if at_level[i] <= most]
    if not found and high:
        page_itself = region < 0 or page.parents[region][1] == "body"
        inside = [i for i in inside if not lines[i][3] or high[0] <= i <= high[-1] or not at_level[i] and not page_itself]
    return "\n".join(lines[i][0] for i in inside)


SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):  # few pages at a time as Python strings
                part = b.slice(at, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInArrow(run, SCHEMA)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
