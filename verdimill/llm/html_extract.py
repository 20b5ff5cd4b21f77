"""Main text of web pages by composite text density.

A page becomes a tree.  Elements that are never part of an article (menus,
forms, scripts, adverts by tag, role, class or id) are pruned.  For every
node that is left, characters per tag are adjusted for links; a node's
density sum adds the densities of its children.  The subtree with the largest
sum is the core; the smallest density on its path to the body is the
threshold that siblings along the path must reach to belong to it too; no tag
names an article.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidied

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(?=[\s/>]|$))", re.I)
# Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_SCOPE = frozenset("html body article aside main section div nav footer header table td th caption li ul ol dl dd dt form blockquote button object".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tr", "td", "th"}}
_LISTS = frozenset("ul ol dl table".split())
# Elements, roles and words of class or id that mark what is not part of an article.
_NEVER = frozenset("head script style noscript template nav aside footer form iframe object embed svg canvas button select textarea input dialog menu audio video map applet noembed noframes title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu menus "
    "modal nav navbar navigation navigations newsletter notice notices overlay pager pagination popup popups promo promos promoted promotion recommended recommendation recommendations related replies reply respond responses search share sharing "
    "sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HEADINGS = frozenset(("h1", "h2"))


class Node:
    __slots__ = ("tag", "up", "kids", "skip", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None, skip: int):
        self.tag, self.up, self.skip = tag, up, skip
        self.kids: list[Node | str | None] = []  # None: a break between blocks
        if up is not None:
            up.kids.append(self)


_HARD, _SOFT = 2, 1


def _unwanted(tag: str, attrs: str, in_article: bool) -> int:
    """_HARD for what is never shown as text of an article, _SOFT for what only its names say, else 0."""
    if tag in _NEVER or tag == "header" and not in_article:
        return _HARD
    if not attrs or tag in ("html", "body", "main"):
        return 0
    soft = 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" and (attrs[m.start() - 1 : m.start()] or " ").isspace():
            return _HARD
        if name == "aria-hidden" and value.lower() == "true" and tag not in _INLINE:
            return _HARD
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return _HARD
        if name == "role" and value.lower() in _ROLES:
            soft = _SOFT
        if name in ("class", "id") and not _MARKS.isdisjoint(_SPLIT.split(_CAMEL.sub(" ", value).lower())):
            soft = _SOFT
    return soft


def _holds_title(x: Node) -> bool:
    """Whether an element holds the main title or area: then its names tell of the layout, not of the element."""
    todo = [x]
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, Node) and k.skip != _HARD:
                if k.tag in ("h1", "main"):
                    return True
                todo.append(k)
    return False


def parse(html: str) -> Node:
    """A tree of the page; unclosed and misplaced tags are repaired the usual way."""
    root = Node("body", None, 0)
    stack, at, n = [root], 0, len(html)
    soft: list[Node] = []
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].kids.append(html[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                stack[-1].kids.append(None)
            elif tag in ("body", "html"):
                del stack[1:]  # later text still belongs to the body
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if tag in _INLINE and stack[k].tag in _SCOPE:
                        break
                if tag not in _INLINE:
                    stack[-1].kids.append(None)
            continue
        if tag in ("html", "body"):
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _SCOPE:
                    break
        if tag in _SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SAME[tag]:
                    del stack[k:]
                    if tag not in ("tr", "tbody", "tfoot", "thead"):
                        break
                elif stack[k].tag in _LISTS:
                    break
        if stack[-1].tag == "head" and tag not in ("meta", "link", "base", "title", "style", "script", "noscript", "template"):
            stack.pop()
        top = stack[-1]
        if tag in _VOID:
            if tag in ("br", "hr"):
                top.kids.append(None)
            continue
        node = Node(tag, top, _unwanted(tag, m[3], any(x.tag in ("article", "main") for x in stack)))
        if node.skip == _SOFT:
            soft.append(node)
        if tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = close.end() if close else n
        elif not m[3].endswith("/") or tag not in ("svg", "path"):
            stack.append(node)
    for x in soft:
        if _holds_title(x):
            x.skip = 0
    return root


def _measure(root: Node) -> tuple[list[Node], Node]:
    """Densities of all nodes that are left, in document order."""
    nodes: list[Node] = []
    todo = [root]
    while todo:
        x = todo.pop()
        nodes.append(x)
        todo.extend(k for k in reversed(x.kids) if isinstance(k, Node) and not k.skip)
    for x in reversed(nodes):
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        for k in x.kids:
            if isinstance(k, str):
                x.chars += len(k.strip())
            elif isinstance(k, Node) and not k.skip:
                x.chars += k.chars
                x.tags += 1 + k.tags
                x.link_chars += k.link_chars
                x.link_tags += k.link_tags + (k.tag == "a")
        if x.tag == "a":
            x.link_chars = x.chars
    body_c, body_l = max(root.chars, 1), root.link_chars
    for x in nodes:
        x.density = _density(x, body_l / body_c)
    for x in nodes:
        x.total = sum(k.density for k in x.kids if isinstance(k, Node) and not k.skip) or x.density
    # Text that stands in a node directly counts as a child without tags.
    for x in nodes:
        x.total += sum(float(len(k.strip())) for k in x.kids if isinstance(k, str) and k.strip()) if x.tags else 0.0
    return nodes, root


def _density(x: Node, body_ratio: float) -> float:
    c, t = x.chars, max(x.tags, 1)
    if not c:
        return 0.0
    lc, lt = max(x.link_chars, 1), max(x.link_tags, 1)
    plain = max(c - x.link_chars, 1)
    base = math.log(c / plain * x.link_chars + body_ratio * c + math.e)
    inside = c / lc * t / lt
    return c / t * math.log(max(inside, 1.0)) / math.log(max(base, 1.0001)) if inside > 1 else 0.0


def extract(html: str) -> str:
    """The main text of one page: blocks in page order, joined by one space."""
    root = parse(html)
    nodes, root = _measure(root)
    pool = [x for x in nodes if x.chars]
    if not pool:
        return ""
    core = max(pool, key=lambda x: x.total)
    threshold, y = core.density, core
    while y is not None:
        threshold = min(threshold, y.density)
        y = y.up
    chosen = {id(core)}
    x = core
    while x.up is not None:
        for k in x.up.kids:
            if isinstance(k, Node) and not k.skip and k is not x and (k.density >= threshold and k.link_chars * 2 < max(k.chars, 1) or k.tag in _HEADINGS):
                chosen.add(id(k))
        x = x.up
    return _text([x for x in nodes if id(x) in chosen])


def _text(parts: list[Node]) -> str:
    out: list[str] = []

    def walk(x: Node) -> None:
        todo: list[Node | str | None] = [x]
        while todo:
            y = todo.pop()
            if y is None:
                out.append(" ")
            elif isinstance(y, str):
                out.append(unescape(y) if "&" in y else y)
            elif not y.skip:
                gap = [None] if y.tag not in _INLINE else []
                todo.extend(gap + y.kids[::-1] + gap)

    for x in parts:
        walk(x)
        out.append(" ")
    return " ".join("".join(out).split())


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``, repeated rows included; a null page counts as empty, and a page without text has an empty text.  Other columns play no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    out = small_batches(pages).select("page_id", "url", "html").mapInArrow(tidied(run), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
