"""Main text of web pages by composite text density.

A page is read once, by a linear scanner, into its tree of elements, inline ones included.
Each has its characters, tags, link characters and link tags; its density is characters
per tag, adjusted for the part that links have. A block's score is the sum of the densities
of its child blocks and of the text that stands in it directly. The block of the largest
score is selected, whatever its name. The threshold is the least density on the path from
it to the body: what stands beside that path is taken in where it is as dense and of the
same kind; what stands inside the selection, is sparser, and is a list of links goes.

Elements and roles that HTML itself defines as no part of an article (nav, aside, footer,
form and the like) are left out from the start. Words of classes and ids only break ties:
hinted parts count nothing while the page has other text, and inside an article only what
is far below the threshold or mostly links goes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

#: Elements that start and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
#: Elements that are never part of an article.
NOT_ARTICLE = frozenset("nav aside footer form button select dialog menu search head object canvas audio video".split())
NOT_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that tell a part beside the article, alone or with the words below around them.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer discussion disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related "
    "replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
WITHIN = frozenset("article content main post entry story body text page wrapper container layout".split())
#: What stands before and after such a word in compounds (site-header, ad-box, comment-list).
SIDES = frozenset("bottom global left mobile primary right secondary site sticky sub the top".split())
PARTS = frozenset(
    "area bar block bottom box button buttons column container count form group holder icon icons inner item items left link links list message modules "
    "outer panel post posts right row section slot tag top unit wrap wrapper zone".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: For these, as for all within an article, a class or id is a hint only.
TEXT_TAGS = HEADINGS | frozenset("p li dt dd td th".split())
#: The part of an article's density below which what is hinted to be beside it is out.
SPARSE = 0.25
#: The part of a list's characters that are in links.
LINKED = 0.6
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_SIMPLE = re.compile(r"\s*/?>")
_PIECE = re.compile(r"[\s/]+|([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?|=")
_COMMENT_END = re.compile(r"--!?>")
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


class _Node:
    __slots__ = ("tag", "parent", "block", "out", "hint", "linked", "article", "chars", "tags", "link_chars", "link_tags", "own", "index", "last", "density")

    def __init__(self, tag: str, parent: _Node | None, index: int, is_block: bool):
        self.tag, self.parent, self.index, self.last = tag, parent, index, index
        self.block = self if is_block or parent is None else parent.block  # the block that the text stands in
        self.out = parent is not None and parent.out
        self.linked = tag == "a" or parent is not None and parent.linked
        self.article = tag in ("article", "main") or parent is not None and parent.article  # in an article or main
        self.hint = False  # a class puts it beside the article
        self.chars = self.tags = self.link_chars = self.link_tags = self.own = 0
        self.density = 0.0


def _beside(value: str) -> bool:
    """Whether one of the names in a class or id is a word of BESIDE as a whole, or a compound of such words with SIDES and PARTS."""
    for name in value.split():
        words = [w.lower() for w in _NAME.findall(name)]
        while words and words[0] in SIDES:
            words.pop(0)
        while words and words[-1] in PARTS:
            words.pop()
        if words and all(w in BESIDE for w in words):
            return True
    return False


def _look(n: _Node, attributes: dict[str, str]) -> None:
    """Set whether an element is out by what it is, and whether its class hints that it is beside the article."""
    tag = n.tag
    if tag in NOT_ARTICLE or tag == "header" and not n.article:
        n.out = True
    for name, value in attributes.items():
        low = value.lower()
        if name == "hidden" or name == "aria-hidden" and low == "true" or name == "style" and _HIDDEN.search(value) or name == "role" and low in NOT_ARTICLE_ROLES:
            n.out = True
        elif name in ("class", "id") and tag not in ("html", "body", "article", "main") and n.block is n:
            words = {w.lower() for w in _NAME.findall(value)}
            n.hint |= _beside(value) and (not words & WITHIN or bool(words & {"comment", "comments", "commentlist"}))


def _density(chars: int, tags: int, link_chars: int, link_tags: int, body_links: float) -> float:
    """Composite text density: characters per tag, the more lowered the more of them are in links. ``body_links``: the part of the body's characters in links."""
    if not chars:
        return 0.0
    tags = max(1, tags)
    links, link_tags = max(1, link_chars), max(1, link_tags)
    base = math.log(link_chars * chars / max(1, chars - link_chars) + body_links * chars + math.e)
    adjusted = math.log(max(1.0, chars / links * tags / link_tags)) / max(math.log(base), 0.1)
    return chars / tags * adjusted


class _Page:
    """Nodes in page order, each after its parent, and lines of text with the block they stand in."""

    def __init__(self, html: str):
        self.nodes = [_Node("#root", None, 0, True)]
        self.lines: list[tuple[_Node, str]] = []
        self.stack = [self.nodes[0]]
        self.open: Counter[str] = Counter()
        self.pieces: list[str] = []
        self._read(html)
        self._close(1)
        self._flush()
        self.nodes[0].last = len(self.nodes) - 1

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join(unescape("".join(self.pieces)).split())
            self.pieces.clear()
            if text:
                self.lines.append((self.stack[-1].block, text))

    def _add(self, text: str) -> None:
        top = self.stack[-1]
        if top.out:
            return
        self.pieces.append(text)
        if not text.isspace():
            top.chars += len(text)
            if top.linked:
                top.link_chars += len(text)

    def _close(self, to: int) -> None:
        if any(n.block is n for n in self.stack[to:]):
            self._flush()
        for n in self.stack[to:]:
            n.last = len(self.nodes) - 1
            self.open[n.tag] -= 1
        del self.stack[to:]

    def _close_last(self, tags: tuple[str, ...], stops: tuple[str, ...] | None) -> bool:
        """Close the innermost open element of ``tags``, unless one of ``stops`` (None: any block) comes first."""
        if not any(self.open[t] for t in tags):
            return False
        for k in range(len(self.stack) - 1, 0, -1):
            n = self.stack[k]
            if n.tag in tags:
                self._close(k)
                return True
            if n.block is n if stops is None else n.tag in stops:
                return False
        return False

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        is_block = tag in BLOCKS or tag in NOT_ARTICLE
        if is_block:
            if tag in ("html", "body") and self.open[tag]:
                return
            if tag in _CLOSES:
                self._close_last(_CLOSES[tag], _STOPS[tag])
            elif tag == "body" or self.stack[-1].tag == "head":
                self._close_last(("head",), ())
            block = self.stack[-1].block
            if block.tag == "p":  # any block ends an open paragraph
                self._close_last(("p",), ())
            self._flush()
        elif tag == "a":
            self._close_last(("a",), None)
        elif tag == "br" and not self.stack[-1].out:
            self.pieces.append(" ")
        node = _Node(tag, self.stack[-1], len(self.nodes), is_block)
        _look(node, attributes)
        self.nodes.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] += 1

    def _end(self, tag: str) -> None:
        if tag in BLOCKS or tag in NOT_ARTICLE:
            if not self._close_last((tag,), ()):
                self._flush()
        else:
            self._close_last((tag,), None)

    def _attributes(self, html: str, at: int) -> tuple[dict[str, str], int, bool]:
        """Attributes from ``at`` on, where the tag ends, and whether it closes itself. Each character is looked at a bounded number of times."""
        found: dict[str, str] = {}
        last = ""
        while (m := _PIECE.match(html, at)) is not None:
            if m[1]:
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            last = m[0]
            at = m.end()
        return found, at + 1, last.endswith("/") and last.strip("/ \t\r\n\f") == ""

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        last = html.rfind(">")  # no tag ends after it
        while at < end:
            k = html.find("<", at)
            if k < 0:
                self._add(html[at:])
                return
            if k > at:
                self._add(html[at:k])
            if html.startswith("<!--", k):
                if html.startswith((">", "->"), k + 4):
                    at = html.index(">", k) + 1
                else:
                    m = _COMMENT_END.search(html, k + 4)
                    at = m.end() if m else end
                continue
            m = _TAG.match(html, k + 1)
            if m is None:
                if html.startswith(("<!", "<?", "</"), k):
                    at = html.find(">", k) + 1 or end
                else:
                    self._add("<")
                    at = k + 1
                continue
            if k > last:
                return  # a tag that never ends takes in the rest of the page
            tag = m[2].lower()
            simple = _SIMPLE.match(html, m.end())
            if simple:
                attributes, at, closed = {}, simple.end(), "/" in simple[0]
            else:
                attributes, at, closed = self._attributes(html, m.end())
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                if not (closed and tag in ("svg", "math")):
                    e = _RAW_ENDS[tag].search(html, at)
                    at = e.end() if e else end
            else:
                self._start(tag, attributes)


def _count(nodes: list[_Node], gone: set[int]) -> list[tuple[int, int, int, int]]:
    """Characters, tags, link characters and link tags in each element, without what is out or ``gone``."""
    total = [(n.chars, 0, n.link_chars, 0) for n in nodes]
    for n in reversed(nodes):
        if n.parent is not None and not n.out and n.index not in gone:
            c, t, lc, lt = total[n.index]
            pc, pt, plc, plt = total[n.parent.index]
            total[n.parent.index] = pc + c, pt + t + 1, plc + lc, plt + lt + n.linked
    return total


def _weigh(page: _Page, gone: set[int], density) -> tuple[_Node, dict[int, float]]:
    """The body, and the score of each block; densities are set on the nodes."""
    nodes = page.nodes
    total = _count(nodes, gone)
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    c, _, lc, _ = total[body.index]
    body_links = lc / max(1, c)
    inline = [(n.chars, 0, n.link_chars, 0) for n in nodes]  # what stands in a block outside of its child blocks
    score: dict[int, float] = {}
    for n in reversed(nodes):
        if n.out or n.index in gone:
            n.density = 0.0
            continue
        n.density = density(*total[n.index], body_links)
        if n.block is not n:
            c, t, lc, lt = inline[n.index]
            pc, pt, plc, plt = inline[n.parent.index]
            inline[n.parent.index] = pc + c, pt + t + 1, plc + lc, plt + lt + n.linked
        else:
            score[n.index] = score.get(n.index, 0.0) + density(*inline[n.index], body_links)
            up = n.parent.block if n.parent is not None else None
            if up is not None:
                score[up.index] = score.get(up.index, 0.0) + n.density
    return body, score


def _inside(nodes: list[_Node], gone: set[int]) -> set[int]:
    """``gone`` with all that its elements hold."""
    for n in nodes:
        if n.parent is not None and n.parent.index in gone:
            gone.add(n.index)
    return gone


def _prune(page: _Page, region: _Node, least: float, density, body_links: float) -> set[int]:
    """Elements of a selected region that go: sparser than the threshold and either lists of links or hinted to be beside the article."""
    gone: set[int] = set()
    part = page.nodes[region.index : region.last + 1]
    first = next((n.index for n in part if not n.out and not n.linked and n.chars and n.tag not in HEADINGS), region.last)
    total = {n.index: [n.chars, 0, n.link_chars, 0] for n in part}
    held = {n.index: 0 for n in part}  # links, those of lists that have gone too
    for n in reversed(part):
        if n.out or n is region:
            continue
        c, t, lc, lt = total[n.index]
        held[n.parent.index] += held[n.index] + n.linked
        own = density(c, t, lc, lt, body_links)
        links = lc > LINKED * c
        if n.block is n and n.tag not in HEADINGS and own < least:
            listed = links and held[n.index] >= 3 and n.tag in ("ul", "ol", "dl", "div", "section", "table", "p")
            # lists after the first text are part of it, such as its references; other blocks of links only within an article
            stays = n.index > first and (n.tag in ("ul", "ol", "dl", "p") or n.parent.article) and not n.hint
            hinted = n.hint and (links or n.tag not in TEXT_TAGS and own < SPARSE * least)
            if listed and not stays or hinted:
                gone.add(n.index)
                continue
        up = total[n.parent.index]
        up[0], up[1], up[2], up[3] = up[0] + c, up[1] + t + 1, up[2] + lc, up[3] + lt + n.linked
    return _inside(part, gone)


def main_text(html: str | None, density=_density) -> str:
    """The article of a page: its blocks in page order, a line each; empty for a null, empty or textless page.

    A tag that never ends takes in the rest of the page; a quote that never ends is part of its value.
    """
    if not html:
        return ""
    page = _Page(html)
    nodes = page.nodes
    # hints outside articles count only while there is other text
    hinted = _inside(nodes, {n.index for n in nodes if n.hint and not n.article and n.tag not in TEXT_TAGS})
    holds = set()
    for n in reversed(nodes):
        if n.parent is not None and (n.tag in ("article", "main") or n.index in holds):
            holds.add(n.parent.index)
    hinted = _inside(nodes, {i for i in hinted if nodes[i].hint and i not in holds})
    if not any(n.chars and not n.out and n.index not in hinted for n in nodes):
        hinted = set()
    body, score = _weigh(page, hinted, density)
    best = max(score, key=lambda i: (round(score[i], 6), -i), default=0)
    path = [nodes[best]]
    while path[-1].parent is not None and path[-1] is not body:
        path.append(path[-1].parent)
    least = min(n.density for n in path)
    on = {n.index for n in path}
    regions = [path[0]]
    tags = {n.parent.index: n.tag for n in path if n.parent is not None}
    for n in nodes:  # beside the path to the body: as dense, and of the same kind as what is on the path there
        if n.parent is not None and n.parent.index in on and n.parent is not path[0] and n.index not in on and n.block is n and not n.out and n.index not in hinted:
            if n.density >= least and n.chars + n.density > 0 and (n.tag == tags.get(n.parent.index) or n.tag in TEXT_TAGS):
                regions.append(n)
    total = _count(nodes, hinted)[body.index]
    body_links = total[2] / max(1, total[0])
    kept: set[int] = set()
    for r in regions:
        kept.update(range(r.index, r.last + 1))
        kept -= _prune(page, r, least, density, body_links)
    return "\n".join(t for n, t in page.lines if n.index in kept and not n.out and n.index not in hinted)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) in place of ``html``.

    A null, empty or textless page has the text '' and 0. Repeated rows are read each;
    columns named text or n_chars are replaced, all others stay. Memory: a batch and one page's tree.
    """
    kept = pages.drop("text", "n_chars")
    others = [c for c in kept.columns if c != html]
    kept = kept.select(*others, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            more = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*others, "text", "n_chars"])

    return map_arrow(kept, run, kept.drop(html).schema.add("text", "string").add("n_chars", "long"))
