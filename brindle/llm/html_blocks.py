"""HTML to leaf blocks: the text between block-level tags with the path of elements around it."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_PART = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup and no text of the page: skipped to their closing tag.
_RAW = frozenset("script style title textarea iframe noscript".split())
#: Elements with markup inside that is no text of the page; they end with their closing tag or with an element around them.
_HIDDEN = frozenset("template svg math select datalist object audio video canvas".split())
#: Of these, foreign ones and what is in them may close themselves. They and a select end at a start tag of _BREAKS, but for
#: the parts of foreign ones that hold page markup.
_FOREIGN = frozenset("svg math".split())
_HTML_INSIDE = frozenset("foreignobject desc annotation-xml".split())
_BREAKS = frozenset("blockquote body center dd div dl dt em h1 h2 h3 h4 h5 h6 head hr img li menu ol p pre ruby span strong sub sup table ul".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: A start tag of the key closes an open element of the values, up to the nearest of the bounds.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BOUNDS = frozenset("ul ol dl menu table tbody thead tfoot html body article section div nav main aside header footer form".split())
_NO_P_INSIDE = frozenset("td th caption button table".split())


class Block(NamedTuple):
    """node: the number of the innermost element around the text in the page's list of elements, or -1."""

    text: str
    node: int
    link_chars: int


class Element(NamedTuple):
    """An element that was open when text began: its own names, and the number of the element around it, or -1."""

    parent: int
    names: tuple[str, ...]


class Page(NamedTuple):
    blocks: list[Block]
    elements: list[Element]

    def path(self, block: Block) -> tuple[str, ...]:
        """The names of all elements around a block, the outermost first."""
        out, at = [], block.node
        while at >= 0:
            out.append(self.elements[at].names)
            at = self.elements[at].parent
        return tuple(x for names in reversed(out) for x in names)


class _Open:
    """The open elements, with numbers of each tag, so that asking for one costs nothing where there is none."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.count: Counter[str] = Counter()
        self.hidden = self.foreign = 0
        self.elements: list[Element] = []
        self.node: list[int] = []  # of each open element, its number in elements, for those that have one

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.stack.append((tag, names))
        self.count[tag] += 1
        self.hidden += tag in _HIDDEN
        self.foreign += tag in _FOREIGN

    def cut(self, k: int) -> None:
        """Close all from the k-th on."""
        for tag, _ in self.stack[k:]:
            self.count[tag] -= 1
            self.hidden -= tag in _HIDDEN
            self.foreign -= tag in _FOREIGN
        del self.stack[k:]
        del self.node[k:]

    def has(self, tags) -> bool:
        return any(self.count[t] for t in tags)

    def number(self) -> int:
        """The number of the innermost element; elements get theirs when text stands in them for the first time."""
        while len(self.node) < len(self.stack):
            self.elements.append(Element(self.node[-1] if self.node else -1, self.stack[len(self.node)][1]))
            self.node.append(len(self.elements) - 1)
        return self.node[-1] if self.node else -1


def _names(attributes: str) -> list[str]:
    out = []
    for m in _NAMED.finditer(attributes):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
        out += [f"{'#' if m[1].lower() == 'id' else '.'}{w}" for w in _PART.findall(html.unescape(value).lower())]
    return out


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, white space collapsed; a null, empty or text-free page has none."""
    return parse(page).blocks


def parse(page: str | None) -> Page:
    """The leaf blocks of a page and the elements around them, in a time that follows the page's length."""
    out: list[Block] = []
    open_ = _Open()
    if not page:
        return Page(out, open_.elements)
    stack = open_.stack
    text: list[str] = []
    at_node, link = -1, 0

    def flush() -> None:
        nonlocal link
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(joined, at_node, min(link, len(joined))))
            text.clear()
        link = 0

    def add(piece: str) -> None:
        nonlocal at_node, link
        if not piece or open_.hidden:
            return
        if "&" in piece:
            piece = html.unescape(piece)
        if not text or (at_node == -1 and piece.strip()):
            if not piece.strip():
                return
            at_node = open_.number()
        text.append(piece)
        if open_.count["a"]:
            link += len(piece.strip())

    def close(tags, bounds) -> None:
        """Close the innermost element of the tags and all in it, unless one of the bounds lies between."""
        if not open_.has(tags):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                open_.cut(k)
                return
            if stack[k][0] in bounds:
                return

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br" or tag == "wbr":
            if tag == "br":
                add(" ") if text else None
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
        if m[1]:
            if not open_.count[tag]:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    open_.cut(k)
                    break
                if inline and stack[k][0] not in _INLINE | _HIDDEN:
                    break
            continue
        if tag in _BREAKS and (open_.foreign or open_.count["select"]):
            # page markup can't be inside svg, math or a select that was never closed
            for k in range(len(stack)):
                if stack[k][0] in _FOREIGN | {"select"}:
                    if not any(t in _HTML_INSIDE for t, _ in stack[k + 1 :]):
                        open_.cut(k)
                    break
        closes_itself = m[3].rstrip().endswith("/")
        if tag in _RAW:
            if closes_itself and open_.foreign:
                continue
            end = re.compile(rf"</{tag}\s*+/?>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in _VOID:
            continue
        if not inline:
            if tag not in ("html", "body"):
                close(("p",), _NO_P_INSIDE)
            if tag in _CLOSES:
                close(_CLOSES[tag], _BOUNDS)
        if closes_itself and ("-" in tag or tag in _FOREIGN or open_.foreign):
            continue
        open_.push(tag, (tag, *_names(m[3])))
        if tag == "head":
            end = re.compile(r"</head\s*+>|<body", re.I).search(page, at)
            if end:
                at = end.start()
    flush()
    return Page(out, open_.elements)
