"""Main text of web pages by consensus of each host's pages.

A first pass parses every page, credits its words to the containers that hold them and takes the best container; its generalised tag-class
path (numbers in class names are one sign) is the page's vote. Votes are summed per host in Spark, and a host's winning paths are those with a tenth of its
votes or more, most votes first. The second pass extracts from the first winning path that the page has text under, or from the page's own best
container if it has none of them.

Left out wherever they stand: scripts, styles, templates, navigation, footers, asides, forms and controls, hidden parts, headers outside
the article, and elements whose class, id or role names an advert, notice, menu, sidebar, comment section or the like; if nothing is left of a page
so, names are disregarded. Inline tags and `<br>` don't end a block; each other tag does. Character references are decoded as in HTML5,
white space in a block is one space, blank blocks are dropped and the rest is joined by line breaks.

Paths are numbered within a page, and no step walks up or down an element's ancestors, so that deep nesting costs time and memory in proportion to the page.

Defined results: a page is read as a whole, however long; of containers with equal credit the first in the page counts, of a host's paths with equal votes the smallest; null and empty pages, and pages without text, have an empty text; a page without tags is all text; unclosed elements end with their parents, an
unfinished tag at the end is markup; a null url belongs to a host of its own kind; repeated rows are extracted alike; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import html
import re
import sys
from collections import Counter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import BROADCAST_BYTES, join_hot_aware, slices, tidied, written

#: Shares of a host's votes that a path needs to win.
WINNING_SHARE = 0.1

PART = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes)\b[^>]*(?:>.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head nav footer aside form noscript template svg math object canvas button select option menu dialog video audio".split())
CONTAINERS = frozenset("body main article section div td".split())
#: Opening one of these ends an open paragraph; an opening tag of a kind also ends an open one of its own kind up to the given parents.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: A paragraph's or item's end tag ends none that is open outside of these.
BARRIERS = frozenset("td th article main body".split())
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert
    popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer masthead topbar
    comment comments respond disqus share sharing social related recommended recommendations widget widgets pagination pager search toolbar""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
SPLIT_NAME = re.compile(r"[^a-z]+")
NUMBER = re.compile(r"\d+")


def _attributes(rest: str) -> tuple[list[str], str, str, bool]:
    classes, name, role, hidden = [], "", "", False
    for m in ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "class":
            classes = value.split()
        elif key == "id":
            name = value
        elif key == "role":
            role = value
        elif key == "hidden":
            hidden = True
    return classes, name, role, hidden


class Page:
    """A page's elements, in order and parents first, each a place in these lists; and its blocks, each with the innermost element that holds it."""

    def __init__(self):
        self.tag, self.parent, self.path, self.dropped, self.named, self.in_article = ["body"], [-1], [0], [False], [False], [False]
        self.box, self.outer = [0], [-1]  # the nearest container at or above an element, and the outermost article or main element
        self.steps: dict[tuple[int, str], int] = {(-1, "body"): 0}  # paths are numbered: a path is its parent's number and a step
        self.names = [(-1, "body")]
        self.blocks: list[tuple[int, str]] = []

    def add(self, tag: str, parent: int, step: str, dropped: bool, named: bool, in_article: bool) -> int:
        at = len(self.tag)
        key = (self.path[parent], step)
        number = self.steps.setdefault(key, len(self.names))
        if number == len(self.names):
            self.names.append(key)
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(number)
        self.dropped.append(dropped)
        self.named.append(named)
        self.in_article.append(in_article)
        self.box.append(at if tag in CONTAINERS else self.box[parent])
        self.outer.append(at if tag in ("article", "main") and self.outer[parent] < 0 else self.outer[parent])
        return at

    def spelt(self, number: int) -> str:
        """A path as text."""
        out = []
        while number >= 0:
            number, step = self.names[number]
            out.append(step)
        return "/".join(reversed(out))

    def numbered(self, path: str) -> int:
        """The number of a path in this page, or -1."""
        number = -1
        for step in path.split("/"):
            found = self.steps.get((number, step))
            if found is None:
                return -1
            number = found
        return number

    def below(self, number: int) -> list[bool]:
        """Of each element whether it is, or stands below, one with this path."""
        out: list[bool] = []
        for up, own in zip(self.parent, self.path, strict=True):
            out.append(own == number or (up >= 0 and out[up]))
        return out


class Open:
    """The open elements, from the outermost in. Where the innermost of a tag stands is known without a walk, so that pages nested by the thousand cost no more than others."""

    def __init__(self):
        self.element, self.tag = [0], ["body"]
        self.places: dict[str, list[int]] = {"body": [0]}

    def push(self, element: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.tag))
        self.element.append(element)
        self.tag.append(tag)

    def close(self, to: int) -> None:
        """End the elements from place to on, the body aside."""
        while len(self.tag) > max(to, 1):
            self.places[self.tag.pop()].pop()
            self.element.pop()

    def last(self, tags) -> int:
        """The innermost place of any of the tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def first_behind(self, tags, place: int) -> int:
        """The outermost place of any of the tags behind a place, or -1."""
        found = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect.bisect_right(p, place)) < len(p)]
        return min(found, default=-1)


def parse(source: str) -> Page:
    page, stack, pieces = Page(), Open(), []
    at = 0

    def flush():
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                page.blocks.append((stack.element[-1], text))
            pieces.clear()

    for m in PART.finditer(source):
        if m.start() > at:
            pieces.append(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag in ("br", "wbr"):
                pieces.append(" " if tag == "br" else "")
            continue
        flush()
        if tag in ("html", "body"):
            continue
        if m["end"]:
            k = stack.last((tag,))
            if k > 0 and not (tag in ("p", "li") and stack.last(BARRIERS) > k):
                stack.close(k)
            continue
        if tag in ENDS_P:
            k = stack.last(("p",))
            if k > stack.last(CONTAINERS):
                stack.close(k)
        if tag in SIBLINGS:
            same, parents = SIBLINGS[tag]
            inner = stack.last(parents)
            k = stack.first_behind(same, inner) if tag == "tr" else stack.last(same)
            if k > inner:
                stack.close(k)
        if stack.tag[-1] == "head" and tag not in ("meta", "link", "base", "title", "noscript", "template"):
            stack.close(len(stack.tag) - 1)
        if tag in VOID:
            continue
        up, rest = stack.element[-1], m["rest"]
        classes, name, role, hidden = _attributes(rest) if rest else ([], "", "", False)
        in_article = page.in_article[up] or tag in ("article", "main")
        dropped = page.dropped[up] or tag in NEVER or hidden or role in ROLES or (tag == "header" and not in_article)
        named = page.named[up] or (
            bool(classes or name)
            and tag not in ("article", "main")
            and any(w in NAMES for c in (*classes, name) for w in SPLIT_NAME.split(c))
        )
        step = tag + "".join(f".{c}" for c in sorted({NUMBER.sub("#", c).replace("/", "|") for c in classes}))
        made = page.add(tag, up, step, dropped, named, in_article)
        if not rest.endswith("/") or tag not in ("svg", "path"):
            stack.push(made, tag)
    if at < len(source):
        pieces.append(source[at:])
    flush()
    return page


def _kept(page: Page) -> list[tuple[int, str]]:
    """The blocks that aren't left out by their tags and names, or by their tags alone if that leaves none."""
    by_tag = [b for b in page.blocks if not page.dropped[b[0]]]
    return [b for b in by_tag if not page.named[b[0]]] or by_tag


def best_container(page: Page, kept: list[tuple[int, str]]) -> int:
    """The container with most credit: two for each word directly below it, one for each word below a container in it; the first of equals. An article or main element around it stands for it."""
    credit: dict[int, int] = {}
    for element, text in kept:
        words, box = text.count(" ") + 1, page.box[element]
        credit[box] = credit.get(box, 0) + 2 * words
        if page.parent[box] >= 0:
            around = page.box[page.parent[box]]
            credit[around] = credit.get(around, 0) + words
    best = min(credit, key=lambda k: (-credit[k], k))
    return page.outer[best] if page.outer[best] >= 0 else best


def vote(source: str) -> str | None:
    page = parse(source)
    kept = _kept(page)
    return page.spelt(page.path[best_container(page, kept)]) if kept else None


def extract(source: str, paths: list[str]) -> str:
    page = parse(source)
    kept = _kept(page)
    if not kept:
        return ""
    for number in (*map(page.numbered, paths), page.path[best_container(page, kept)]):
        if number >= 0:
            below = page.below(number)
            if found := [text for element, text in kept if below[element]]:
                break
    return "\n".join(found)


def host(url: Column) -> Column:
    """The lower-case host of a url; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _votes(batches):
    for whole in batches:
        for batch in slices(whole, 1):
            found = Counter()
            for name, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = vote(source or "")
                if path is not None:
                    found[name, path] += 1
            keys = [*found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([*found.values()], pa.int64())],
                names=["host", "path", "n"],
            )


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths, n): each host's winning paths, most votes first, and its number of votes."""
    slim = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    votes = written(slim.mapInArrow(tidied(_votes), "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("n")), "votes")
    total = votes.groupBy("host").agg(F.sum("n").alias("total"))
    won = votes.join(total, "host").where(F.col("n") >= F.col("total") * WINNING_SHARE)  # ten paths of a host at most
    ranked = won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "path"))).alias("all"), F.first("total").alias("n"))
    return written(ranked.select("host", F.transform("all", lambda v: v["path"]).alias("paths"), "n"), "paths")


def _texts(batches):
    for whole in batches:
        for batch in slices(whole, 2):
            texts = [extract(s or "", p or []) for s, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    won = winning_paths(pages)
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        host(F.col("url")).alias("host"),
    )
    size = won.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length(F.array_join("paths", " ")) + 64), F.lit(0)), F.sum("n")).first()
    if size[0] <= BROADCAST_BYTES:
        known = slim.join(F.broadcast(won.drop("n")), "host", "left").select(*slim.columns, "paths")
    else:
        known = join_hot_aware(slim, won, "host", "n", size[1], "left")
    return known.select("page_id", "url", "html", "paths").mapInArrow(tidied(_texts), "page_id long, url string, text string, n_chars long")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
