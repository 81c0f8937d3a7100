"""HTML main text by composite text density.

A tokenizer and a tree builder for HTML as it is found (implied end tags, unclosed and stray tags, comments, raw text
elements) give a DOM whose blocks hold text. For every node, with C characters, T tags, LC characters and LT tags in
links, and the page's share of link characters,

    density = C / T * log_b(C / LC * T / LT),   b = ln(C / (C - LC) * LC + LC_body / C_body * C + e),

with zero counts taken as one, so that links pull a node's characters per tag down. A node's sum is that of its children's
densities; the node with the largest sum holds the content and is taken with all its text. The threshold is the least density on the
path from the body to it: siblings along this path (elements, or runs of text between them) that reach it and aren't mostly links are
content too. Along the part of the path that lies in an article (or else main) element, siblings of less density are content as well if
they aren't mostly links, and outside of that element nothing is.

Left out: scripts, styles, controls and other elements without text, menus, footers, asides and headers (but those inside an
article) that are closed by a tag of their own; and nodes that are only *named* as something else: forms, hidden elements, and those
whose class, id or role says menu, sidebar, notice, advert or comments. Names like has-sidebar or no-comments say nothing. A named node
that holds over half of the body's text is a wrapper and stays, unless article or main elements outside of it hold ``PARAGRAPH``
characters or a quarter of its own; one named as
comments stays only if it holds an article, main or h1 element, or if the rest has under ``PARAGRAPH`` characters.

Text: character references decoded, white space (Unicode's, so no-break spaces too) inside a block made one blank, blocks trimmed, empty
ones dropped, joined by \\n. A tag ends at the first > outside of quoted values; where a page has no such end, quotes no longer
count in the rest of the page, and without any > what is left is text. Time is linear in a page's length.
Defined results: null and empty pages give an empty text; pages with a null id are read like others; a page without markup is its text;
repeated rows get equal results; other columns, whatever their names, are ignored; an empty table gives an empty result. Pages are read whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
#: The rest of a tag: quotes count after an equals sign only.
_TAIL = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIP = frozenset("script style noscript template svg math canvas audio video object embed iframe button select option textarea input label head title nav footer aside menu dialog map applet frameset noframes noembed".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose start ends an open one of the set, up to the given boundary.
_CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: Names of things that aren't the article, as whole parts of a class, id or role.
_COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
_OTHER = _COMMENTS | frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner banners menu menus nav navbar navigation navi breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager skip toc tags print paywall search searchbox complementary contentinfo".split())
#: A name that begins so tells of the page's state, not of the node.
_STATE = frozenset("has with without no not is hide hides show shows enable enabled disable disabled layout".split())
_PART = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Marks of a node: none, named as something else, named as comments, left out for its element.
PLAIN, NAMED, COMMENTS, OUT = 0, 1, 2, 3
PARAGRAPH = 100


class Node:
    __slots__ = ("tag", "children", "mark", "skip", "chars", "tags", "link_chars", "link_tags", "density", "total", "parent", "heads", "closed")

    def __init__(self, tag: str, parent: Node | None, mark: int = PLAIN):
        self.tag, self.parent, self.mark = tag, parent, mark
        self.children: list[Node | str] = []
        self.skip = self.closed = False


def _mark(tag: str, attrs: str, in_article: bool) -> int:
    if tag in SKIP or tag == "header" and not in_article:
        return OUT
    if tag in ("html", "body", "article", "main"):
        return PLAIN
    mark = NAMED if tag == "form" else PLAIN
    for name, value in _ATTR.findall(attrs) if attrs.strip() else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = [p.lower() for p in _PART.split(word) if p]
                if parts and (len(parts) == 1 or parts[0] not in _STATE) and not _OTHER.isdisjoint(parts):
                    mark = max(mark, NAMED if _COMMENTS.isdisjoint(parts) else COMMENTS)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            mark = max(mark, NAMED)
    return mark


def parse(html: str) -> Node:
    root = Node("html", None)
    open_ = [root]
    places: dict[str, list[int]] = {"html": [0]}  # depths of the open elements by name
    block_at = [0]  # depths of open blocks
    quotes, at, n = True, 0, len(html)

    def close(depth: int) -> None:
        while len(open_) > depth:
            x = open_.pop()
            places[x.tag].pop()
            if block_at[-1] == len(open_):
                block_at.pop()

    def last(tag: str) -> int:
        got = places.get(tag)
        return got[-1] if got else -1

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            open_[-1].children.append(html[at:])
            break
        after = html[lt + 1 : lt + 2]
        ends = after == "/"
        m = _NAME.match(html, lt + 1 + ends)
        if after in ("!", "?"):
            if lt > at:
                open_[-1].children.append(html[at:lt])
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        if m is None:
            open_[-1].children.append(html[at : lt + 1])
            at = lt + 1
            continue
        tail = _TAIL.match(html, m.end()) if quotes else None
        end = tail.end() if tail else 0
        if tail is None:
            quotes = False
            end = html.find(">", m.end()) + 1
            if not end:
                open_[-1].children.append(html[at:])
                break
        if lt > at:
            open_[-1].children.append(html[at:lt])
        at = end
        tag = m[0].lower()
        if ends:
            depth = last(tag)
            # an inline end tag doesn't end a block around it
            if depth > 0 and (tag in BLOCK or depth > block_at[-1]):
                open_[depth].closed = True
                close(depth)
            continue
        attrs = html[m.end() : end - 1]
        if tag == "body":
            close(1)
        elif last("head") > 0 and tag not in IN_HEAD:
            open_[last("head")].closed = True
            close(last("head"))
        if tag in _CLOSES_P and open_[block_at[-1]].tag == "p":
            close(block_at[-1])
        if tag in _SIBLING:
            names, stops = _SIBLING[tag]
            stop = max(0, *map(last, stops)) if stops else 0
            found = [d[k] for d in map(places.get, names) if d and (k := bisect_right(d, stop)) < len(d)]
            if found:
                close(min(found))
        top = open_[-1]
        node = Node(tag, top, _mark(tag, attrs, last("article") > 0 or last("main") > 0))
        top.children.append(node)
        if tag in RAW:
            node.closed = True
            stop_at = re.compile(f"</{tag}", re.I | re.A).search(html, at)
            shut = html.find(">", stop_at.end()) if stop_at else -1
            at = n if shut < 0 else shut + 1
        elif tag not in VOID and (tag in BLOCK or not attrs.rstrip().endswith("/")):
            places.setdefault(tag, []).append(len(open_))
            if tag in BLOCK:
                block_at.append(len(open_))
            open_.append(node)
        else:
            node.closed = True
    return root


def _settle(root: Node) -> None:
    """Which nodes are left out."""
    order: list[Node] = []
    stack = [root]
    while stack:
        x = stack.pop()
        order.append(x)
        if x.mark == OUT and not x.closed:
            x.mark = PLAIN  # an element without end would take the rest of the page along
        if x.mark == OUT:
            x.skip = True
        else:
            stack += [c for c in x.children if not isinstance(c, str)]
    # of each node: characters, characters in articles, whether it holds an article, main or h1 element
    for x in reversed(order):
        x.chars = x.tags = x.heads = 0
        if x.skip:
            continue
        for c in x.children:
            if isinstance(c, str):
                x.chars += _visible(c)
            else:
                x.chars += c.chars
                x.tags += c.tags
                x.heads |= c.heads
        if x.tag in ("article", "main"):
            x.tags = x.chars
        x.heads |= x.tag in ("article", "main", "h1")
    whole, articles = root.chars, root.tags
    for x in order:
        if x.mark in (NAMED, COMMENTS):
            wraps = 2 * x.chars > whole and articles - x.tags < min(PARAGRAPH, x.chars / 4)
            x.skip = not (wraps and (x.mark == NAMED or x.heads or whole - x.chars < PARAGRAPH))


def _visible(text: str) -> int:
    return sum(map(len, text.split()))


def _density(x: Node, page: float) -> float:
    """page: share of characters in links in the body. Without any link there it is plain characters per tag."""
    per_tag = x.chars / max(1, x.tags)
    base = math.log(x.chars / max(1, x.chars - x.link_chars) * x.link_chars + page * x.chars + math.e)
    if base <= 1:
        return per_tag
    odds = x.chars / max(1, x.link_chars) * max(1, x.tags) / max(1, x.link_tags)
    return per_tag * math.log(max(1.0, odds)) / math.log(base)


def _measure(root: Node) -> Node:
    """Counts bottom up, then densities and their sums; nodes left out count nothing."""
    order: list[Node] = []
    stack = [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.children if not isinstance(c, str) and not c.skip]
    for x in reversed(order):
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        for c in x.children:
            if isinstance(c, str):
                x.chars += _visible(c)
            elif not c.skip:
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.chars if c.tag == "a" else c.link_chars
                x.link_tags += c.link_tags + (c.tag == "a")
    body = next((x for x in order if x.tag == "body"), root)
    page = body.link_chars / max(1, body.chars)
    for x in reversed(order):
        x.density = _density(x, page)
        x.total = sum(k.density for k in x.children if not isinstance(k, str) and not k.skip)
    return body


def _runs(x: Node) -> list[Node | list[Node | str]]:
    """The children: blocks, and the runs of text and inline elements between them."""
    out: list[Node | list[Node | str]] = []
    for c in x.children:
        if isinstance(c, str) or c.tag not in BLOCK:
            if not out or isinstance(out[-1], Node):
                out.append([])
            out[-1].append(c)
        else:
            out.append(c)
    return out


def _as_node(run: list[Node | str]) -> Node:
    """A run as a node with counts of its own."""
    x = Node("", None)
    x.children = run
    inner = [c for c in run if not isinstance(c, str) and not c.skip]
    x.chars = sum(_visible(c) for c in run if isinstance(c, str)) + sum(c.chars for c in inner)
    x.tags = sum(c.tags + 1 for c in inner)
    x.link_chars = sum(c.chars if c.tag == "a" else c.link_chars for c in inner)
    x.link_tags = sum(c.link_tags + (c.tag == "a") for c in inner)
    return x


def content_roots(root: Node) -> list[Node]:
    """Nodes whose text is the content, in page order."""
    _settle(root)
    body = _measure(root)
    best, stack = body, [body]
    while stack:
        x = stack.pop()
        if x.total > best.total:
            best = x
        stack += [c for c in x.children if not isinstance(c, str) and not c.skip]
    while best.tag not in BLOCK and best is not body and best.parent is not None:
        best = best.parent  # an inline element isn't cut out of its block
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(p.density for p in path)
    page = body.link_chars / max(1, body.chars)
    holder = {tag: [k for k, p in enumerate(path) if p.tag == tag] for tag in ("article", "main")}
    top = max(holder["article"] or holder["main"], default=-1)
    before: list[Node] = []
    behind: list[Node] = []
    for k, (inner, outer) in enumerate(zip(path, path[1:], strict=False)):
        if top >= 0 and k >= top:
            break
        sides: tuple[list[Node], list[Node]] = ([], [])
        side = 0
        for c in _runs(outer):
            if c is inner or isinstance(c, list) and any(x is inner for x in c):
                side = 1
                if c is inner:
                    continue
                at = next(i for i, x in enumerate(c) if x is inner)
                parts = [(0, c[:at]), (1, c[at + 1 :])]
            else:
                parts = [(side, c)]
            for which, part in parts:
                x = _as_node(part) if isinstance(part, list) else part
                if x.skip or not x.chars or 2 * x.link_chars >= x.chars:
                    continue
                if top >= 0 or (_density(x, page) if x.tag == "" else x.density) >= threshold:
                    sides[which].append(x)
        before[:0] = sides[0]
        behind += sides[1]
    return [*before, best, *behind]


def blocks(node: Node) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif not x.skip:
            if x.tag == "br":
                run.append(" ")
            elif x.tag in BLOCK:
                end()
                stack.append(None)
                stack += reversed(x.children)
            else:
                stack += reversed(x.children)
    end()
    return out


def extract(html: str | None) -> str:
    if not html:
        return ""
    return "\n".join(b for node in content_roots(parse(html)) for b in blocks(node))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of pages."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(columns: list) -> list[tuple]:
        return [(i, u, t, len(t)) for i, u, t in ((i, u, extract(h)) for i, u, h in zip(*columns, strict=True))]

    return map_rows(rows, "page_id bigint, url string, text string, n_chars bigint", run)
