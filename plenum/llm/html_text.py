"""Main text of web pages by consensus of each host.

Every page scores its containers. The best container votes for its generalised path (tags and
classes, without digits); Spark counts the votes of a host; then every page is read again
with the winning path of its host. A page that has no such container falls back on its own
best one.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import staged, text_lists

# Kinds of HTML elements.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
             "sub sup time tt u var wbr".split())
RAW = set("script style noscript textarea title template iframe noframes xmp svg".split())
CONTAINERS = set("body main article section div td".split())
NESTED = CONTAINERS | set("html head table nav aside header footer form menu dialog fieldset figure ul ol dl details button select video audio object".split())
DROPPED = set("head nav aside footer menu dialog button select video audio object".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
DROPPED_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation navi "
    "breadcrumb breadcrumbs masthead footer foot cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe "
    "subscription signup social share sharing related recommended recommendations comment comments reply replies discussion disqus respond widget "
    "pagination pager login toolbar hidden copyright disclaimer commentlist adbox adslot adsbygoogle sidenav topnav toc".split())
HEADER_WORDS = {"header", "topbar", "head"}
#: Hints at what others write or sell, which may be most of a page: of these an article inside is asked for.
FOREIGN_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay newsletter "
    "subscribe subscription signup social share sharing related recommended recommendations comment comments reply replies discussion disqus respond "
    "commentlist adbox adslot adsbygoogle".split())
#: A class that begins like this tells of other parts of the page ("has-sidebar").
ABOUT = set("has with without no not is".split())
GOOD_WORDS = set("content article post entry story main text body".split())

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z][^\s/>]*))")
_EDGE = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[^a-z]+")
#: Where an element ends that is not read; searched in the page itself, since lower-casing may change its length.
_END = {name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in RAW}


#: A wrapper with a hint against it needs this share of the text of the page to be read.
MOST = 0.5
#: Without an article inside, so much beside it is next to nothing.
LITTLE = 0.1
#: A longer path goes on from a digest of itself, so deep pages stay small.
PATH = 500


@dataclass
class Node:
    path: str
    parent: int
    dropped: bool  # for certain, or in the end
    hint: bool  # against it
    foreign: bool
    inside: bool  # of an article or main element
    candidate: bool
    good: bool  # an article, or named like one
    bonus: float
    holder: int  # the next candidate from here upwards
    own: int = 0  # characters outside links
    text: int = 0  # of a candidate: characters of its own blocks
    links: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    pieces: list[tuple[int, str, bool, bool]] = field(default_factory=list)  # node, text, inside a link, "a block ends after it"


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)} if raw.strip(" /\n\t\r") else {}


def _open(page: Page, parent: int, tag: str, raw: str) -> int:
    up = page.nodes[parent] if parent >= 0 else None
    attributes = _attributes(raw)
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    words = {w for n in names if (parts := _PART.split(n)) and parts[0] not in ABOUT for w in parts}
    inside = tag in ("article", "main") or (up is not None and up.inside)
    dropped = up is not None and up.dropped
    named = tag not in ("html", "body", "article", "main")
    hint = named and bool(words & DROPPED_WORDS or tag == "form")
    if not dropped and named:
        header = tag == "header" or bool(words & HEADER_WORDS)
        dropped = (tag in DROPPED or (header and not inside) or attributes.get("role", "").lower() in DROPPED_ROLES
                   or "hidden" in attributes or attributes.get("aria-hidden") == "true"
                   or "display:none" in attributes.get("style", "").replace(" ", "").lower())
    if not dropped and tag == "article" and words & {"comment", "comments", "reply"}:
        dropped = True
    classes = sorted(_PART.split(attributes.get("class", "").lower())) if "class" in attributes else []
    step = ".".join([tag, *[c for c in classes if c]])
    above = up.path if up else ""
    if len(above) > PATH:
        above = hashlib.md5(above.encode()).hexdigest()
    good = tag in ("article", "main") or (tag in CONTAINERS and tag != "body" and not hint and bool(words & GOOD_WORDS))
    bonus = {"article": 1.5, "main": 1.3}.get(tag, 1.0) * (1.25 if words & GOOD_WORDS and tag != "body" else 1.0)
    at, candidate = len(page.nodes), tag in CONTAINERS
    page.nodes.append(Node(f"{above}/{step}" if up else step, parent, dropped, hint, bool(words & FOREIGN_WORDS), inside, candidate, good, bonus,
                           at if candidate or up is None else up.holder))
    return at


def _settle(page: Page) -> None:
    """Decide on the wrappers with a hint against them, keep the pieces that are left and add them up."""
    nodes = page.nodes
    under, good = [n.own for n in nodes], [n.good and not n.dropped for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        under[nodes[i].parent] += under[i]
        good[nodes[i].parent] |= good[i]
    # what stays if every hint is followed
    kept = [n.own for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        if not nodes[i].hint:
            kept[nodes[i].parent] += kept[i]
    inner = [False] * len(nodes)  # an article below the node itself
    for i in range(1, len(nodes)):
        inner[nodes[i].parent] |= good[i]
    for i, n in enumerate(nodes):
        if i and nodes[n.parent].dropped:
            n.dropped = True
        elif n.hint and not n.dropped:
            most = under[i] > 0 and under[i] >= MOST * under[0]
            n.dropped = not (most and (inner[i] or (not n.foreign and kept[0] <= LITTLE * under[i])))
    page.pieces = [p for p in page.pieces if not nodes[p[0]].dropped]
    for node, text, linked, _ in page.pieces:
        size = len(text.strip())
        holder = nodes[nodes[node].holder]
        holder.text += size
        holder.links += size if linked else 0


def parse(source: str) -> Page:
    """Containers and text pieces of a page; broken markup is read as far as it goes.

    The page is read forwards once. A quote that never ends makes all quotes after it plain
    characters of their tags; a ``<`` without any ``>`` behind it is text.
    """
    page = Page()
    stack, open_names = [("", _open(page, -1, "html", ""))], Counter()
    place, links, quotes = 0, False, True

    def add(text: str) -> None:
        node = stack[-1][1]
        if not text or page.nodes[node].dropped:
            return
        if "&" in text:
            text = html.unescape(text)
        page.pieces.append((node, text, links, False))
        if not links:
            page.nodes[node].own += len(text.strip())

    def end_block() -> None:
        if page.pieces and not page.pieces[-1][3]:
            page.pieces[-1] = (*page.pieces[-1][:3], True)

    def leave(depth: int) -> None:
        open_names.subtract(name for name, _ in stack[depth:])
        del stack[depth:]

    def tag_end(at: int) -> int:
        """The place of the ``>`` that ends a tag, -1 without one."""
        nonlocal quotes
        while quotes:
            edge = _EDGE.search(source, at)
            if edge is None or edge[0] == ">":
                return edge.start() if edge else -1
            at = source.find(edge[0], edge.end()) + 1
            if not at:
                quotes = False
                return source.find(">", edge.end())
        return source.find(">", at)

    while True:
        tag = _OPEN.search(source, place)
        if tag is None:
            add(source[place:])
            break
        if tag[0] == "<!--" or tag[0] == "<![CDATA[":
            add(source[place:tag.start()])
            mark = "-->" if tag[0] == "<!--" else "]]>"
            end = source.find(mark, tag.end())
            if mark == "]]>":
                add(source[tag.end(): end if end >= 0 else len(source)].replace("&", "&amp;"))
            if end < 0:
                break
            place = end + 3
            continue
        end = source.find(">", tag.end()) if tag[2] is None else tag_end(tag.end())
        if end < 0:
            quotes = False
            if (end := source.find(">", tag.end())) < 0:  # no tag any more, but perhaps a comment
                rest = source.find("<!--", tag.end())
                add(source[place: rest if rest >= 0 else len(source)])
                break
        add(source[place:tag.start()])
        place = end + 1
        if tag[2] is None:
            continue
        name, closing, raw = tag[2].lower(), tag[1] == "/", source[tag.end():end]
        if name == "a":
            links = not closing
        if name not in INLINE:
            end_block()
        if not closing and name in RAW:
            stop = _END[name].search(source, place)
            if stop is None:
                break
            place = source.find(">", stop.end()) + 1 or len(source)
        elif name in NESTED:
            if closing:
                if open_names[name]:
                    leave(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
            elif name != "html":
                if name == "body":
                    leave(1)
                stack.append((name, _open(page, stack[-1][1], name, raw)))
                open_names[name] += 1
        elif name == "h1" and not closing:
            page.nodes[stack[-1][1]].good = True
    _settle(page)
    return page


def best_container(page: Page) -> tuple[int, float]:
    """The container with the highest score, and the score; (-1, 0) when a page has no text.

    Text outside links counts for its container in full and for the containers above half as
    much each step; of equal scores the outer one wins.
    """
    scores = [0.0] * len(page.nodes)
    for i, n in enumerate(page.nodes):
        worth, up = max(n.text - 2 * n.links, 0) + 0.0, i
        while worth >= 1 and up >= 0:
            up = page.nodes[up].holder
            scores[up] += worth
            worth /= 2
            up = page.nodes[up].parent
    best = max(range(len(scores)), key=lambda i: (scores[i] * page.nodes[i].bonus, -i), default=-1)
    if best < 0 or scores[best] <= 0:
        texts = [p for p in page.pieces if p[1].strip()]
        return (0, 0.0) if texts else (-1, 0.0)
    return best, scores[best] * page.nodes[best].bonus


def text_of(page: Page, roots: set[int]) -> str:
    """Blocks inside the given containers, in page order, joined by one blank."""
    inside = []
    for i, n in enumerate(page.nodes):
        inside.append(i in roots or (n.parent >= 0 and inside[n.parent]))
    blocks, run = [], []
    for node, text, _, ends in page.pieces:
        if inside[node]:
            run.append(text)
        if ends and run:
            blocks.append("".join(run))
            run = []
    blocks.append("".join(run))
    return " ".join(" ".join(b.split()) for b in blocks if b.strip())


def vote(source: str | None) -> tuple[str | None, float]:
    """The generalised path of the best container of a page and its score."""
    page = parse(source or "")
    best, score = best_container(page)
    return (page.nodes[best].path if best >= 0 else None), score


def extract(source: str | None, path: str | None) -> str:
    """The main text of a page under the winning path of its host."""
    page = parse(source or "")
    roots = {i for i, n in enumerate(page.nodes) if n.path == path and not n.dropped}
    text = text_of(page, roots) if roots else ""
    if text:
        return text
    best, _ = best_container(page)
    return text_of(page, {best}) if best >= 0 else ""


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty when there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame, *, url: str = "url", source: str = "html") -> DataFrame:
    """(host, path): per host the path with most votes; ties go to the higher score, then the smaller path.

    Votes are summed per (host, path) before any host is looked at as a whole, so a host with
    a third of all pages is a handful of partial sums.
    """

    @F.arrow_udf("path string, score double")
    def ballot(texts: pa.Array) -> pa.Array:
        found = [vote(t) for part in text_lists(texts) for t in part]
        return pa.StructArray.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["path", "score"])

    votes = pages.select(host_of(F.col(url)).alias("host"), ballot(F.coalesce(F.col(source), F.lit(""))).alias("b")).select("host", "b.*")
    counts = votes.where("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.round("score")).alias("score"))
    order = F.struct(-F.col("votes"), -F.col("score"), F.col("path"))
    return counts.groupBy("host").agg(F.min_by("path", order).alias("path"))


#: Up to so many hosts their winning paths (about 100 bytes each) are broadcast; beyond, pages are joined by host.
BROADCAST_HOSTS = 200_000


def extract_pages(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text) of every row of ``pages``.

    Null and empty pages, and pages without main text, give the empty text. Pages without a
    host vote together. Repeated rows count as pages of their own. Other columns are ignored.
    """
    winners = staged(winning_paths(pages, url=url, source=source), "host-paths")
    few = winners.count() <= BROADCAST_HOSTS

    @F.arrow_udf("string")
    def read(texts: pa.Array, paths: pa.Array) -> pa.Array:
        sources = (t for part in text_lists(texts) for t in part)
        return pa.array([extract(t, p) for t, p in zip(sources, paths.to_pylist(), strict=True)], pa.string())

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(source), F.lit("")).alias("_html"), host_of(F.col(url)).alias("host"))
    joined = rows.join(F.broadcast(winners) if few else winners, "host", "left")
    return joined.select("page_id", "url", read("_html", "path").alias("text"))
