"""Main text of web pages by composite text density.

The page becomes a DOM (void tags, implied ends of paragraphs, list items and
cells, raw text of scripts).  Scripts, styles and form controls leave, and do
not part the sentence round them.  Menus, asides, forms, page headers and
footers leave by their tag, role or hidden state, and boxes (never paragraphs,
headings, list items, quotes) by names that consist of such words, like
"site-menu", "comments" or "cookie-notice"; but nothing that holds the largest
article or main element leaves, nor, on a page without one, what holds most of
the page's text.  A box with such a word among others, like "related-work",
leaves outside of articles.  Within an article a named box stays if it is a part
of it (it has the title, or is a section, or goes by an id, with heading and
paragraphs, few links and no form controls), except for reader comments; one
with such a word among others leaves only if most of its characters are links.
For every other node, with C characters, T tags, LC link characters and LT link
tags below it,

    density = C/T * ln(C/LC * T/LT) / ln(1 + ln(C/(C-LC) * LC + LCb/Cb * C + e))

(zero counts stand for one; b: of the body; one is added so that pages without
links stay defined).  The node with the largest sum of its children's densities
is the content; the smallest density on its path to the body is the threshold
at which other subtrees add their own best node.  A chosen node inside an
article or main element stands for that element, so titles and short
paragraphs stay, as does the header of an article with all it holds.  Nothing
else inside a chosen node is dropped or cut; formulas, drawings and embedded
objects give the text that they hold, within the sentence.

Nulls: a null page has empty text; null ids and urls stay null.  A page without
text has empty text.  Of nodes that tie the first in page order is the best.
Repeated rows each give a row.  Pages of any length and depth are parsed whole,
in linear time; an empty table gives no row.  Only page_id, url and html are
read: other columns, whatever their names, are left out.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .flat import slices

# Tags by their part in the page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template iframe textarea title select noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark math noscript object q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
_FOREIGN = frozenset(("math", "svg"))
_GONE_TAGS = frozenset("head script style template iframe textarea title select button input noframes".split())
_DROP_TAGS = frozenset("nav footer aside form menu dialog".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_PROSE = frozenset("html body article main p h1 h2 h3 h4 h5 h6 hgroup li dt dd td th tr tbody thead tfoot blockquote pre figure figcaption".split()) | _INLINE
_DROP_WORDS = re.compile(r"ads?|adverts?|advertisements?|advertising|adbox|adsense|banners?|promos?|promotions?|sponsor(?:s|ed)?|menus?|nav|navbar|navigation|breadcrumbs?|sidebar|aside|footer|masthead|comments?|commentlist|disqus|respond|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|widgets?|toolbar|pagination|pager|skip|hidden|header")
_FILLERS = re.compile(r"site|page|post|main|top|bottom|left|right|global|primary|secondary|box|block|list|area|section|wrap|wrapper|container|inner|outer|items?|bar|links?|icons?|buttons?|form|panel|group|posts|articles|stories|js|wp|[0-9]+")
_OF_ARTICLE = frozenset("page post entry article story content".split())  # beside "header"
_OF_READERS = frozenset("comment comments commentlist disqus respond".split())
_NEVER_MAIN = frozenset("nav footer aside menu".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTROLS = frozenset("button input select textarea".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",)}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


_NEVER, _WEAK, _STRONG = 0, 1, 2


class _Node:
    __slots__ = ("article", "below", "best", "by_id", "chars", "density", "drop", "end", "foreign", "i", "kids", "link_chars", "link_tags", "named", "off", "parent", "parts", "readers", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: _Node | None, i: int):
        self.tag, self.parent, self.i, self.drop, self.off, self.named = tag, parent, i, tag in _GONE_TAGS, tag in _DROP_TAGS, _NEVER
        self.by_id = False  # its id alone is such a name
        self.readers = parent is not None and parent.readers  # in what readers wrote
        self.foreign = tag in _FOREIGN or parent is not None and parent.foreign
        self.parts: list = []  # text and nodes in order
        self.kids: list[_Node] = []

    @property
    def inline(self) -> bool:
        return self.foreign or self.tag in _INLINE or self.tag in _GONE_TAGS


def _take_names(n: _Node, attrs: str) -> None:
    """Reads the role, the state and the names of an element off its attributes."""
    at = set()
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "role":
            n.off |= value.lower() in _DROP_ROLES
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            n.off = True
        elif key == "style":
            n.off |= bool(_UNSEEN.search(value))
        elif n.tag not in _PROSE or n.tag == "article":
            for name in value.split():
                parts = [x.lower() for x in _NAME.findall(name)]
                said = [x for x in parts if _DROP_WORDS.fullmatch(x) and not (x == "header" and _OF_ARTICLE.intersection(parts))]
                if said:
                    sure = all(x in said or _FILLERS.fullmatch(x) for x in parts)
                    n.readers |= sure and bool(_OF_READERS.intersection(said))
                    if n.tag != "article":
                        n.named = max(n.named, _STRONG if sure else _WEAK)
                        at.add(key)
    n.by_id = at == {"id"}
    if n.tag in ("html", "body"):
        n.off = False


class _Open:
    """The open elements, with the depths at which each tag, each block and each block but paragraphs is open."""

    def __init__(self, root: _Node):
        self.stack = [root]
        self.depths: dict[str, list[int]] = {root.tag: [0]}
        self.blocks, self.walls = [0], [0]

    def push(self, n: _Node) -> None:
        depth = len(self.stack)
        self.stack.append(n)
        self.depths.setdefault(n.tag, []).append(depth)
        if not n.inline:
            self.blocks.append(depth)
            if n.tag != "p":
                self.walls.append(depth)

    def cut(self, depth: int) -> None:
        """Close what is open from ``depth`` on; the root stays."""
        while len(self.stack) > max(1, depth):
            n = self.stack.pop()
            self.depths[n.tag].pop()
            if not n.inline:
                self.blocks.pop()
                if n.tag != "p":
                    self.walls.pop()

    def last(self, tag: str) -> int:
        found = self.depths.get(tag)
        return found[-1] if found else -1


def parse(page: str) -> list[_Node]:
    """All nodes of the DOM of a page in page order."""
    root = _Node("html", None, 0)
    nodes, opened, pos, end = [root], _Open(root), 0, len(page)
    last_end, has_body = page.rfind(">"), False
    while pos < end:
        node = opened.stack[-1]
        m = _TAG.search(page, pos) if pos <= last_end or "<!--" in page[pos:] else None
        if m is None:
            node.parts.append(page[pos:])
            break
        if m.start() > pos:
            node.parts.append(page[pos : m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            at = opened.last(tag)
            # a stray inline or paragraph end does not close blocks
            if at > 0 and (at >= opened.walls[-1] or tag not in _INLINE and tag != "p"):
                opened.cut(at)
            continue
        if tag in ("html", "body") and (tag == "html" or has_body):
            continue
        if tag not in _INLINE and tag not in _GONE_TAGS and not node.foreign:
            if opened.stack[opened.blocks[-1]].tag == "p":
                opened.cut(opened.blocks[-1])
            if tag == "body" or opened.stack[-1].tag == "head" and tag not in ("meta", "link", "base"):
                has_body |= tag == "body"
                opened.cut(1)
        if tag in _CLOSES:
            wall = max(opened.last(t) for t in _SCOPE[tag])
            found = []
            for t in _CLOSES[tag]:
                depths = opened.depths.get(t, ())
                k = bisect_right(depths, wall)
                found += depths[k : k + 1]
            if found:
                opened.cut(min(found))
        node = opened.stack[-1]
        new = _Node(tag, node, len(nodes))
        if m[3]:
            _take_names(new, m[3])
        node.parts.append(new)
        nodes.append(new)
        if tag in _RAW:
            close = _close(tag).search(page, pos)
            pos = close.end() if close else end
        elif tag not in _VOID and not m[3].endswith("/"):
            opened.push(new)
    return nodes


def _close(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I)


def _measure(nodes: list[_Node]) -> None:
    """Characters, tags and links below each node; where its subtree ends."""
    for n in reversed(nodes):
        own = sum(len(x) - x.count(" ") - x.count("\n") for x in n.parts if isinstance(x, str))
        n.chars = own + sum(k.chars for k in n.kids)
        n.tags = sum(k.tags + 1 for k in n.kids)
        n.link_chars = n.chars if n.tag == "a" else sum(k.link_chars for k in n.kids)
        n.link_tags = sum(k.link_tags + (k.tag == "a") for k in n.kids)


def _grown(nodes: list[_Node]) -> list[_Node]:
    """``nodes`` without what hangs below a dropped one, numbered anew, with their children and the ends of their subtrees."""
    out = []
    for n in nodes:
        if n.parent is None or not n.drop and not n.parent.drop:
            n.i = len(out)
            out.append(n)
        else:
            n.drop = True
    for n in out:
        n.parts = [x for x in n.parts if isinstance(x, str) or not x.drop]
        n.kids = [x for x in n.parts if isinstance(x, _Node)]
    for n in reversed(out):
        n.end = n.kids[-1].end if n.kids else n.i + 1
    return out


def _kept_whole(nodes: list[_Node]) -> set[int]:
    """Nodes that hold the article: above the largest article and main element, or else on the way to where most of the text is."""
    holds: set[int] = set()
    for tag in ("article", "main"):
        found = max((n for n in nodes if n.tag == tag and not n.readers), key=lambda n: n.chars, default=None)
        while found is not None and found.i not in holds:
            holds.add(found.i)
            found = found.parent
    if holds:
        return holds
    at, half = nodes[0], nodes[0].chars / 2
    while at is not None:
        holds.add(at.i)
        at = next((k for k in at.kids if k.chars > half and not k.readers and k.tag not in _NEVER_MAIN), None)
    return holds


_TITLE, _HEADING, _PARAGRAPH, _CONTROL = 1, 2, 4, 8


def _look_below(nodes: list[_Node]) -> None:
    """Which of a title, headings, paragraphs and form controls each node holds."""
    for n in nodes:
        n.below = 0
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.below |= n.below | _TITLE * (n.tag == "h1") | _HEADING * (n.tag in _HEADINGS) | _PARAGRAPH * (n.tag == "p") | _CONTROL * (n.tag in _CONTROLS)


def _is_part(n: _Node) -> bool:
    """Whether a named box in an article is a part of it."""
    if n.readers or n.link_chars > n.chars / 2:
        return False
    section = (n.tag == "section" or n.by_id) and n.below & _HEADING and n.below & _PARAGRAPH and not n.below & _CONTROL
    return bool(n.below & _TITLE or section)


def _prune(nodes: list[_Node]) -> list[_Node]:
    """The nodes that may be content: by tag, role and name, and by density where names are not sure."""
    _look_below(nodes)
    nodes = _grown(nodes)
    _measure(nodes)
    holds = _kept_whole(nodes)
    for n in nodes:
        n.article = n if n.tag in ("article", "main") and not n.readers else n.parent.article if n.parent else None
    settled = 0  # boxes within one that was asked already go with it
    for n in nodes:
        if n.i in holds or n.i < settled:
            continue
        n.drop = n.off or n.tag == "header" and n.article is None or n.readers and n.named == _STRONG or n.readers and n.tag == "article"
        if n.named and not n.drop:
            if n.article is None:
                n.drop = True
            elif n.named == _STRONG and n.tag != "header":
                n.drop = not _is_part(n)
        if n.drop:
            settled = n.end
    nodes = _grown(nodes)
    _measure(nodes)
    for n in nodes:
        n.drop = n.named == _WEAK and n.link_chars > n.chars / 2 and n.parent is not None and n.i > 0 and not any(k.article is k for k in n.kids)
    return _grown(nodes)


def _weigh(nodes: list[_Node], body: _Node) -> None:
    _measure(nodes)
    share = body.link_chars / max(1, body.chars)
    for n in nodes:
        n.density = 0.0
        if n.chars:
            c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
            base = math.log(1 + math.log(c / max(1, c - n.link_chars) * n.link_chars + share * c + math.e))
            n.density = max(0.0, c / t * math.log(max(1.0, c / lc * t / lt)) / base)
    for n in reversed(nodes):
        n.sum = sum(x.density for x in n.kids)
        n.best = n
        for k in n.kids:
            if k.best.sum > n.best.sum or n.best is not n and k.best.sum == n.best.sum and k.best.i < n.best.i:
                n.best = k.best


def choose(nodes: list[_Node], body: _Node) -> list[_Node]:
    """The content nodes of a pruned, weighed tree, none within another."""
    if not body.best.sum:
        return [body]
    threshold, at = body.best.density, body.best
    while at is not body:
        threshold, at = min(threshold, at.density), at.parent
    threshold = min(threshold, body.density)
    chosen: dict[int, _Node] = {}
    i, end = body.i, body.end
    while i < end:
        n = nodes[i]
        if i in chosen or n.density < threshold or not n.chars:
            i = n.end
            continue
        best = n.best if n.best.sum else n
        whole = best.article or best
        chosen[whole.i] = whole
        i = whole.end if whole.i <= i else i + 1
    out, reach = [], -1
    for i in sorted(chosen):
        if i >= reach:
            out.append(chosen[i])
            reach = chosen[i].end
    return out


def blocks(root: _Node, chosen: list[_Node]) -> list[str]:
    """Text of the chosen nodes, a string per block, in page order."""
    wanted = {id(n) for n in chosen}
    out: list[str] = []
    run: list[str] = []

    def end():
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    # (node, next part, inside a chosen node)
    stack = [(root, 0, id(root) in wanted)]
    while stack:
        n, i, inside = stack.pop()
        if i == len(n.parts):
            if not n.inline:
                end()
            continue
        stack.append((n, i + 1, inside))
        part = n.parts[i]
        if isinstance(part, str):
            if inside:
                run.append(part)
        elif part.tag == "br":
            run.append(" ")
        else:
            if not part.inline:
                end()
            stack.append((part, 0, inside or id(part) in wanted))
    end()
    return out


def main_text(page: str) -> str:
    """The article of a page: blocks joined by two line ends, empty if none."""
    nodes = _prune(parse(page))
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    _weigh(nodes, body)
    return "\n\n".join(blocks(body, choose(nodes, body)))


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of ``pages(page_id, url, html)``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h or "") for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
