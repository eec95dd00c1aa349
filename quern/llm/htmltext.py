"""Main-text extraction by composite text density.

Every node of the page's tree has a number of characters, of tags, and of both inside links. Its density is
characters per tag, lowered by a logarithm where links carry much of the text. The node whose children's
densities add up to most is the article's; nodes elsewhere count too if their density is no lower than the least
on the path from the body to that node.

Elements that are never article text, by their name or by a class, id or role that names furniture as a whole word of its own, are
taken out first. Where the page names no article and one such class or id holds most of its text, the name is not believed and
density decides. A page is read in time proportional to its length, however its markup is broken.
"""

from __future__ import annotations

import html as entities
import math
import re
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_rows

# Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
NEVER_TEXT = frozenset("head script style noscript template nav header footer aside form iframe object embed svg math canvas audio video button select textarea input menu dialog noembed noframes title link meta".split())
#: Classes, ids and roles that mark what is not the article.
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs cookie cookies consent footer header login menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget contentinfo complementary search".split()
)
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
#: Words that say where or what form, and join one of the above to a mark of the same sense ("site-header", "commentList").
NEUTRAL = frozenset("site main primary secondary global top bottom left right upper lower inner outer area bar block box list item items wrapper wrap container content section panel slot unit links form count thread".split())
#: A subtree with more than this share of the text holds most of it.
MOSTLY = 0.8
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Opening one of the first closes an open one of the second, up to the nearest of the third.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])), "tfoot": (frozenset(["thead", "tbody", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
#: A p stays open across inline elements only.
P_SCOPE = frozenset("article aside blockquote body button caption center dd details div dl fieldset figure footer form header html li main nav object ol section table td th ul".split())

OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
QUOTED = re.compile(r"=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+)))?")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    """``skipped``: not article text; ``doubtful``: only because of a class, id or role, or as a form around an article.
    ``headings``: only headings below count."""

    __slots__ = ("tag", "children", "skipped", "doubtful", "headings", "chars", "tags", "link_chars", "link_tags", "density", "total", "chosen")

    def __init__(self, tag: str, skipped: bool, doubtful: bool = False, headings: bool = False):
        self.tag, self.skipped, self.doubtful, self.headings, self.children = tag, skipped, doubtful, headings, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.chosen = False


def names_furniture(mark: str) -> frozenset[str]:
    """The furniture that a class, id or role names: all its parts do, or say where it is. ``has-sidebar`` names none."""
    parts = {x.lower() for x in PARTS.findall(mark) if not x.isdigit()}
    return frozenset(parts & (NOT_ARTICLE | COMMENTS)) if parts <= NOT_ARTICLE | COMMENTS | NEUTRAL else frozenset()


def marks_out(tag: str, attributes: str) -> tuple[bool, bool]:
    """(never article text, but only by a class, id or role that may mislead)."""
    if tag in NEVER_TEXT:
        return True, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    named: set[str] = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for mark in "".join(values).split():
                named |= names_furniture(mark)
    return bool(named), bool(named) and named.isdisjoint(COMMENTS)


class Page:
    """Finds in a page; what does not occur any more costs nothing to look for."""

    def __init__(self, text: str):
        self.text = text
        self.last = {x: text.rfind(x) for x in (">", "-->", "]]>", '"', "'")}

    def find(self, what: str, at: int) -> int:
        return self.text.find(what, at) if at <= self.last[what] else -1

    def tag_end(self, at: int) -> int:
        """Where the ``>`` of a tag is that began before ``at``; quotes count only where a value begins, and only if they end. -1 if nowhere."""
        close = self.find(">", at)
        while close >= 0:
            quote = QUOTED.search(self.text, at, close)
            end = self.find(quote[1], quote.end()) if quote else -1
            if end < 0:
                break
            at = end + 1
            if close < at:
                close = self.find(">", at)
        return close


class Open:
    """The open elements, and where in the stack each kind of them is."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, upto: int) -> None:
        while len(self.stack) > upto:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag not in INLINE:
                self.blocks.pop()

    def nearest(self, tags: frozenset[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags: frozenset[str], scope: frozenset[str]) -> None:
        """Closes the nearest of ``tags`` and those around it, as a cell closes with its row, up to the nearest of ``scope``."""
        while (at := self.nearest(tags)) and at >= self.nearest(scope):
            self.cut(at)


def parse(page: str) -> Node:
    """The page's tree of nodes and strings. Broken markup is closed the way browsers do it in the common cases; a tag or comment without
    an end reaches to the end of the page."""
    root = Node("#root", False)
    source, tree, at = Page(page), Open(root), 0

    def text(upto: int) -> None:
        if upto > at and not tree.stack[-1].headings:
            tree.stack[-1].children.append(page[at:upto])

    while m := OPENING.search(page, at):
        text(m.start())
        tag = m[2]
        if tag is None:
            end = "-->" if m[0] == "<!--" else "]]>" if page.startswith("<![CDATA[", m.start()) and source.last["]]>"] > m.end() else ">"
            close = source.find(end, m.end())
            if close < 0:
                return root
            at = close + len(end)
            continue
        tag = tag.lower()
        close = source.tag_end(m.end())
        if close < 0:
            return root
        attributes, at = page[m.end() : close], close + 1
        if m[1]:
            place = tree.places.get(tag)
            if place and (tag not in INLINE or place[-1] > tree.blocks[-1]):
                tree.cut(place[-1])
            continue
        if tag in CLOSES_P:
            tree.close(frozenset(["p"]), P_SCOPE)
        if tag in SIBLINGS:
            tree.close(*SIBLINGS[tag])
        if tag == "body":
            tree.cut(1 + (len(tree.stack) > 1 and tree.stack[1].tag == "html"))
        parent = tree.stack[-1]
        own_header = tag == "header" and bool(tree.places.get("article"))
        skipped, doubtful = (False, False) if own_header else marks_out(tag, attributes)
        node = Node(tag, skipped, doubtful, own_header or parent.headings and tag not in HEADINGS)
        parent.children.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            close = source.find(">", end.end()) if end else -1
            if close < 0:
                return root
            at = close + 1
            continue
        if tag in ("article", "main"):
            for form in tree.places.get("form", ()):
                tree.stack[form].doubtful = True
        tree.push(node)
    text(len(page))
    return root


def believe(root: Node) -> None:
    """Takes back the mark of a doubtful subtree with most of the text, if no article or main element lies outside all marked ones.

    Within it the next marked subtree is held against the same text.
    """
    while True:
        named, held, outer, todo = False, 0, [], [root]
        while todo:
            node = todo.pop()
            if node.skipped:
                if node.doubtful:
                    outer.append((size_of(node), node))
                continue
            named |= node.tag in ("article", "main")
            held += sum(len(c) for c in node.children if isinstance(c, str) and c.strip())
            todo += [c for c in node.children if isinstance(c, Node)]
        if named or not outer:
            return
        size, node = max(outer, key=itemgetter(0))
        if size <= MOSTLY * (held + sum(s for s, _ in outer)):
            return
        node.skipped = False


def size_of(root: Node) -> int:
    """Characters of text in a subtree, without elements that are never text."""
    size, todo = 0, [root]
    while todo:
        node = todo.pop()
        size += sum(len(c) for c in node.children if isinstance(c, str) and c.strip())
        todo += [c for c in node.children if isinstance(c, Node) and (c.doubtful or not c.skipped)]
    return size


def in_order(root: Node) -> list[Node]:
    """The nodes that count, parents first. A stack, as pages may nest deeper than Python calls."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.skipped]
    return out


def measure(root: Node) -> list[Node]:
    """Sets every node's counts, density and sum of its block children's densities."""
    nodes = in_order(root)
    for node in reversed(nodes):
        for child in node.children:
            if isinstance(child, str):
                node.chars += len("".join(child.split()))
            elif not child.skipped:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
    all_chars, all_links = max(1, root.chars), root.link_chars
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
        if c:
            base = math.log(c / max(1, c - lc) * lc + all_links / all_chars * c + math.e)
            inside = c / max(1, lc) * t / max(1, lt)
            node.density = c / t * max(0.0, math.log(inside) / math.log(base)) if base > 1 + 1e-9 else c / t * max(0.0, math.log(inside))
        # inline markup shapes a paragraph and is not a part of its own
        node.total = sum(x.density for x in node.children if isinstance(x, Node) and not x.skipped and x.tag not in INLINE)
    return nodes


def choose(root: Node) -> None:
    """Marks the nodes whose subtrees are article text."""
    nodes = measure(root)
    best = max(nodes, key=lambda n: n.total)
    if best.total <= 0:
        best = root
    parent = {id(c): n for n in nodes for c in n.children if isinstance(c, Node)}
    path, at = [best], best
    while id(at) in parent and at.tag != "body":
        at = parent[id(at)]
        path.append(at)
    threshold = min(n.density for n in path)
    best.chosen = True
    # elsewhere: block nodes as dense as the sparsest on the path, and not around the chosen one
    around = {id(n) for n in path}
    body = path[-1]
    todo = [body] if body is not best else []
    while todo:
        node = todo.pop()
        for child in node.children:
            if isinstance(child, str) or child.skipped or child is best or child.tag in INLINE:
                continue
            if id(child) in around or child.density < threshold:
                todo.append(child)
            elif child.chars:
                child.chosen = True


def blocks(root: Node) -> list[str]:
    """Texts of the chosen nodes' blocks in page order, references decoded, white space folded."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(text)

    todo: list[tuple[Node | str | None, bool]] = [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            if inside:
                held.append(node)
        elif not node.skipped:
            here = inside or node.chosen
            if node.tag == "br" and here:
                held.append(" ")
            block = node.tag not in INLINE
            if block:
                flush()
                todo.append((None, False))
            todo += [(c, here) for c in reversed(node.children)]
    flush()
    return out


def main_text(page: str) -> str:
    root = parse(page)
    believe(root)
    choose(root)
    return "\n\n".join(blocks(root))


FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points).

    Null or empty html, and pages without text, give the empty text. Null ids and urls are carried through; repeated rows are
    extracted each; other columns are ignored. One pass, no shuffle; a page is held by one task only.
    """

    def make():
        def one(page_id: int | None, url: str | None, page: str | None) -> tuple:
            text = main_text(page) if page else ""
            return page_id, url, text, len(text)

        return one

    return map_rows(pages.select(F.col("page_id").cast("long"), "url", "html"), make, "page_id long, url string, text string, n_chars long", FIELDS)
