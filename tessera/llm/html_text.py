"""Operator 2: main text of a page by composite text density.

The page is parsed into a tree. For every node the link-adjusted characters per tag are computed (more links, less
density) and the densities of its children summed. The least density on the path from the densest node up to the body
is the threshold: among nodes that reach it, the subtree with the largest sum is the article. Where other children of
a node above reach the threshold too (an article in several sections), the highest such node is taken. An article,
main or articleBody mark bounds the choice: the subtree is sought inside marks, and the topmost mark around it is
taken, with other marked articles beside it that reach the threshold. Text is taken block by block: the subtree of the
largest sum and what reaches the threshold whole; of what else was taken around them, elements that are mostly links
are dropped, while titles, captions and cells stay.

Hints. Scripts, styles, controls and hidden elements hold no text. An element that its tag, role, class or id calls a
menu, notice, form, advert or the like does not count, unless the page's text lies in it: a hint is ignored where
nothing else is left, where the only marked article is inside, or where it holds OUTWEIGHS times the text of all the
rest (not for reader comments). A class counts only if all its words say so (``sidebar``, ``post-comments``); where one
word of several does (``has-sidebar``, ``related-work``), the element is left out only if it is mostly links.

Defined results: null, empty and text-less pages give the empty text; unclosed elements are closed as browsers do
for paragraphs, list items and table parts, or by their ancestors; an unclosed comment, script or tag runs to the
end; character references are decoded once; of equal sums the first in page order wins; very long pages take time in
proportion to their length; repeated rows each get their own output row; other columns are not read. A line break is
white space inside its block.
"""

from __future__ import annotations

import heapq
import html as references
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
#: Elements whose text is never shown as text.
NO_TEXT = frozenset("head script style noscript iframe noembed noframes template svg button select option textarea input object canvas audio video title xmp".split())
#: Elements that hint at what is not article; a header only outside of marked content.
AROUND = frozenset("nav footer aside form dialog menu fieldset header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in a class or id that tell what is not article, those for reader comments, and words that tell nothing.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner promo promotion sponsor sponsored sidebar cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription "
    "share sharing social related recommended breadcrumb breadcrumbs menu nav navbar navigation footer masthead pagination pager widget login signup toolbar skip tags".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
NEUTRAL = frozenset("site page post main area box block list item items section wrapper wrap container inner outer holder group links link buttons button left right top bottom primary secondary global mobile desktop bar panel row col the and of to js is".split())
#: A hinted element is the article after all where it holds so many times the text of all the rest.
OUTWEIGHS = 4
NONE, WEAK, STRONG, COMMENT = range(4)
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
    "tbody": frozenset(["thead", "tbody", "tr", "td", "th"]), "tfoot": frozenset(["tbody", "tr", "td", "th"]),
}
SCOPES = frozenset("ul ol table tr tbody thead dl select body article section div".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li".split())
CONTENT = frozenset("article main".split())


class Node:
    __slots__ = ("tag", "parent", "children", "out", "content", "hint", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, out: bool, content: bool, hint: int = NONE):
        self.tag, self.parent, self.children, self.out, self.content, self.hint = tag, parent, [], out, content, hint
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _called(value: str) -> int:
    """What a class or id says: each of its words apart by white space is judged by all its parts."""
    hint = NONE
    for name in value.split():
        parts = [w.lower() for w in NAME_PART.findall(name)]
        said = [w for w in parts if w in MARKS or w in COMMENTS]
        if said:
            whole = all(w in MARKS or w in COMMENTS or w in NEUTRAL for w in parts)
            hint = max(hint, WEAK if not whole else COMMENT if said[-1] in COMMENTS else STRONG)
    return hint


def _told(tag: str, attributes: str, inside_content: bool) -> tuple[bool, bool, int]:
    """(without text, content, hint) by element and attributes."""
    out, content = tag in NO_TEXT, tag in CONTENT
    hint = STRONG if tag in AROUND and not (tag == "header" and inside_content) else NONE
    if attributes and not out and tag not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out = True
            elif name == "role":
                hint, content = max(hint, STRONG if value.lower() in ROLES else NONE), content or value.lower() in ("main", "article")
            elif name == "itemprop" and value == "articleBody":
                content = True
            elif name in ("class", "id"):
                hint = max(hint, _called(value))
    if content and not (hint == COMMENT and tag != "main"):
        hint = NONE
    return out, content and hint == NONE and not out, hint


def parse(page: str) -> Node:
    """The page's tree; a child is a Node or a piece of text. Raw text and what is never shown is not kept."""
    root = now = Node("html", None, False, False)
    at, n = 0, len(page)
    low = None
    while at < n:
        m = TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at and not now.out:
            now.children.append(page[at:end])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = now
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                now = node.parent
            elif tag == "p" and not now.out:
                now.children.append(Node("p", now, False, False))
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P:
            node = now
            while node is not None and (node.tag in INLINE or node.tag == "p"):
                if node.tag == "p":
                    now = node.parent
                    break
                node = node.parent
        if tag in CLOSED_BY:
            node = now
            while node is not None and node.tag not in CLOSED_BY[tag] and (node.tag not in SCOPES or tag in ("tr", "tbody", "tfoot") and node.tag in ("tr", "tbody")):
                node = node.parent
            if node is not None and node.tag in CLOSED_BY[tag]:
                now = node.parent
        out, content, hint = _told(tag, m[3], now.content)
        node = Node(tag, now, out or now.out, content or now.content and hint != COMMENT, hint)
        if not node.out:
            now.children.append(node)
        if tag in RAW:
            low = page.lower() if low is None else low
            if len(low) != n:
                low = "".join(c.lower() if c.isascii() else c for c in page)
            close = low.find(f"</{tag}", at)
            if close < 0:
                break
            at = page.find(">", close) + 1 or n
        elif tag not in VOID and not m[3].endswith("/"):
            now = node
    return root


def page_order(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.out]
    return order


def _add_up(order: list[Node]) -> None:
    """Characters, tags and their link parts of every subtree."""
    for node in order:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
    for node in reversed(order):
        node.chars += sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        node.tags += 1
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags


def apply_hints(root: Node) -> None:
    """Leaves out what hints call no article, but for elements that hold the page's text."""
    order = page_order(root)
    if not any(n.hint for n in order):
        return
    _add_up(order)
    own = lambda n: n.chars - n.link_chars
    # the hinted elements directly below each, and those with marked content, as their own and anywhere inside
    below: dict[Node, list[Node]] = {root: []}
    above, here = {root: root}, set()
    for n in order[1:]:
        top = above[n.parent]
        if n.hint in (STRONG, COMMENT):
            below[top].append(n)
            below[n] = []
            top = n
        above[n] = top
        if n.content:
            here.add(top)
    marked = set(here)
    for n in reversed(below):  # in page order, so what lies deeper comes first
        if any(c in marked for c in below[n]):
            marked.add(n)
    tops, rest = below[root], own(root) - sum(map(own, below[root]))
    heap = [(-own(n), i, n) for i, n in enumerate(tops)]
    heapq.heapify(heap)
    kept, found, k = set(), root in here, len(heap)
    while heap:
        size, _, n = heapq.heappop(heap)
        if not found and (n in marked or rest <= 0 < -size or n.hint != COMMENT and -size > OUTWEIGHS * rest):
            found = n in here
            kept.add(n)
            rest += own(n) - sum(map(own, below[n]))
            for c in below[n]:
                heapq.heappush(heap, (-own(c), k, c))
                k += 1
        elif -size <= 0:
            break
    for n in order:
        if n.hint == WEAK:
            n.out = 2 * n.link_chars > n.chars and not n.content
        elif n.hint and n not in kept:
            n.out = True


def measure(root: Node) -> list[Node]:
    """All nodes in page order, with characters, tags and link parts of their subtrees, densities and sums."""
    order = page_order(root)
    _add_up(order)
    body_chars, body_links = max(root.chars, 1), root.link_chars
    for node in order:
        c, t, lc, lt = node.chars, node.tags, node.link_chars, node.link_tags
        if c:
            base = math.log(c / max(c - lc, 1) * lc + body_links / body_chars * c + math.e)
            node.density = c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1)), 0.0) / max(math.log(base), 1e-9) if base > 1.0001 else c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1)), 0.0) / 1e-4
    for node in order:
        node.sum = sum(c.density for c in node.children if isinstance(c, Node) and not c.out) or node.density
    return order


def article(root: Node) -> list[Node]:
    """The subtree with the largest density sum among nodes that reach the threshold of the densest node's path, and
    marked articles beside it."""
    order = [n for n in measure(root) if n.chars]
    if not order:
        return []
    marked = [n for n in order if n.content]
    order = marked or order
    densest = max(order, key=lambda n: n.density)
    threshold, node = densest.density, densest
    while node is not None and (not marked or node.content):
        threshold, node = min(threshold, node.density), node.parent
    best = node = dense = max((n for n in order if n.density >= threshold), key=lambda n: n.sum)
    while not marked and node.parent is not None:
        # a section outsums the element that holds all sections
        node, below = node.parent, node
        if any(isinstance(c, Node) and not c.out and c is not below and c.chars and c.density >= threshold for c in node.children):
            best = node
    while best.parent is not None and best.parent.content or best.tag in INLINE and best.parent is not None:
        best = best.parent
    _drop_links(best, dense, threshold)
    if not best.content:
        return [best]
    # articles beside the one that was found
    tops = [n for n in marked if not n.parent.content]
    beside = lambda n: 2 * n.link_chars <= n.chars and (n.density >= threshold or n.tag == best.tag and n.parent is best.parent)
    return [n for n in tops if n is best or beside(n)]


def _drop_links(top: Node, dense: Node, threshold: float) -> None:
    """Leaves out, below ``top`` and around ``dense``, what is below the threshold and mostly links."""
    path, node = {dense}, dense
    while node is not top and node.parent is not None:
        node = node.parent
        path.add(node)
    stack = [top] if dense is not top else []
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str) or c is dense or c.out or c.tag in INLINE:
                continue
            if c in path:
                stack.append(c)
            elif c.density < threshold:
                c.out = 2 * c.link_chars > c.chars
                if not c.out:
                    stack.append(c)


def blocks(nodes: list[Node]) -> list[str]:
    """The blocks of subtrees: pieces of text between block borders, references decoded, white space as one space."""
    out, piece, stack = [], [], nodes[::-1]

    def border() -> None:
        if piece:
            if text := " ".join("".join(piece).split()):
                out.append(text)
            piece.clear()

    while stack:
        x = stack.pop()
        if x is None:
            border()
        elif isinstance(x, str):
            piece.append(references.unescape(x))
        elif x.out:
            border()
        elif x.tag == "br":
            piece.append("\n")
        else:
            if x.tag not in INLINE:
                border()
                stack.append(None)
            stack += reversed(x.children)
    border()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    apply_hints(root)
    return "\n".join(blocks(article(root)))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in part.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return arrow_map(picked, run, "page_id long, url string, text string, n_chars long", rows=64)
