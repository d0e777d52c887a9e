"""A small tree over the standard HTML parser, for card-shaped pages.

Used inside Arrow-batched functions only; prices, titles and URLs are settled by Column
expressions afterwards.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

_VOID = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)
_CLOSED_BY = {"li": ("li",), "p": ("p",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
              "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_STEP = re.compile(r"([a-z0-9]*)((?:\.[\w-]+)*)(#[\w-]+)?((?:\[[^\]]+\])*)", re.I)
_ATTR = re.compile(r"\[([\w-]+)(?:([*^]?=)['\"]?([^'\"\]]*)['\"]?)?\]")


_UNSEEN = ("script", "style")

#: Tags and texts that the parser reads in one way only; elements whose content is no markup are not
#: among them.
_PLAIN = re.compile(
    r"<(?:(/)([a-zA-Z][a-zA-Z0-9]*)[ \t\n]*"
    r"|(?!(?i:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)[ \t\n>])"
    r"([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z0-9-]*=\"[^\"]*\")*)[ \t\n]*)>"
)
_PLAIN_ATTR = re.compile(r"([a-zA-Z][a-zA-Z0-9-]*)=\"([^\"]*)\"")
#: Longest attributes of a tag that are kept for the next tag with the same.
_KEPT_ATTRS = 128


class Page:
    """Elements and shown texts of a page in document order: what a node holds is a range of each.

    ``known`` keeps what readers have found out about the page as a whole.
    """

    __slots__ = ("nodes", "pieces", "known", "_joined", "_hits")

    def __init__(self):
        self.nodes: list[Node] = []
        self.pieces: list[str] = []
        self.known: dict = {}
        self._joined: dict[str, tuple[str, list[int]]] = {}
        self._hits: dict[str, list[int]] = {}

    def hits(self, selectors: str) -> list[int]:
        """Places of all elements that one of the alternatives matches."""
        if selectors not in self._hits:
            plans = [_compile(part.strip()) for part in selectors.split(",")]
            own = [plan[-1] for plan in plans]
            ends = [(i, n) for i, n in enumerate(self.nodes) if _fits_any(n, own)]
            self._hits[selectors] = [
                i for i, n in ends if any(_matches(n, plan) for plan in plans)
            ]
        return self._hits[selectors]

    def joined(self, separator: str) -> tuple[str, list[int]]:
        """All texts as one, and where each begins in it."""
        if separator not in self._joined:
            steps = (len(piece) + len(separator) for piece in self.pieces)
            starts = list(accumulate(steps, initial=0))
            self._joined[separator] = (separator.join(self.pieces), starts)
        return self._joined[separator]


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "page", "place", "past", "begin", "end")

    def __init__(self, tag, attrs, parent, page):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.page, self.place, self.begin = page, len(page.nodes), len(page.pieces)
        self.past = self.end = None
        page.nodes.append(self)

    def close(self):
        """Nothing that comes later on the page is below this node."""
        self.past, self.end = len(self.page.nodes), len(self.page.pieces)

    def below(self) -> tuple[int, int]:
        """The range of places of its descendants."""
        return self.place + 1, len(self.page.nodes) if self.past is None else self.past

    def walk(self):
        """Descendants in document order."""
        return (self.page.nodes[i] for i in range(*self.below()))

    def span(self, separator: str = "") -> tuple[str, int, int]:
        """The page's text and the range of it that this node shows."""
        text, starts = self.page.joined(separator)
        begin = starts[self.begin]
        # The last piece has no separator behind it.
        end = starts[len(self.page.pieces) if self.end is None else self.end] - len(separator)
        return text, begin, max(begin, end)

    def text(self, separator: str = "") -> str:
        if self.tag in _UNSEEN:
            return separator.join(t.strip() for t in self.children if t.strip())
        text, begin, end = self.span(separator)
        return text[begin:end]

    def attr(self, name: str) -> str:
        return self.attrs.get(name) or ""

    def select(self, selectors: str) -> list[Node]:
        """Matching descendants in document order; commas give alternatives."""
        return list(self.matching(selectors))

    def matching(self, selectors: str):
        """Like ``select``, one match at a time."""
        hits = self.page.hits(selectors)
        first, past = self.below()
        for i in range(bisect_left(hits, first), bisect_left(hits, past)):
            yield self.page.nodes[hits[i]]

    def first(self, *selectors: str) -> Node | None:
        """First match of the first selector that has one."""
        for selector in selectors:
            found = next(self.matching(selector), None)
            if found is not None:
                return found
        return None

    def ancestors(self, limit: int | None = None):
        node, steps = self.parent, 0
        while node is not None and (limit is None or steps < limit):
            yield node
            node, steps = node.parent, steps + 1


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.root = self.current = Node("", {}, None, self.page)
        self.open = Counter()

    def parse_marked_section(self, i, report=1):
        """Skip a section such as ``<![if x]>`` whatever its keyword."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def updatepos(self, i, j):
        """Nobody asks for line numbers."""
        return j

    def read(self, html: str) -> None:
        """The page's plain beginning in one scan, and what follows it by the parser."""
        at, size = 0, len(html)
        while at < size:
            begin = html.find("<", at)
            if begin < 0:
                break
            tag = _PLAIN.match(html, begin)
            if tag is None:
                break
            if at < begin:
                self.handle_data(unescape(html[at:begin]))
            closes, closed, opened, attrs = tag.groups()
            if closes:
                self.handle_endtag(closed.lower())
            else:
                known = _attributes if len(attrs) <= _KEPT_ATTRS else _attributes.__wrapped__
                self.handle_starttag(opened.lower(), known(attrs))
            at = tag.end()
        if at < size:
            self.feed(html[at:])
        self.close()

    def handle_starttag(self, tag, attrs):
        if self.current.tag in _CLOSED_BY.get(tag, ()):
            self._leave()
        node = Node(tag, dict(attrs), self.current, self.page)
        self.current.children.append(node)
        if tag in _VOID:
            node.close()
        else:
            self.current = node
            self.open[tag] += 1

    def _leave(self):
        self.open[self.current.tag] -= 1
        self.current.close()
        self.current = self.current.parent

    def handle_startendtag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.current, self.page)
        node.close()
        self.current.children.append(node)

    def handle_endtag(self, tag):
        # A tag that is not open closes nothing, however deep the page.
        if self.open[tag] > 0:
            while self.current.tag != tag:
                self._leave()
            self._leave()

    def handle_data(self, data):
        self.current.children.append(data)
        if self.current.tag not in _UNSEEN and (shown := data.strip()):
            self.page.pieces.append(shown)


@lru_cache(maxsize=4096)
def _attributes(text: str) -> tuple[tuple[str, str], ...]:
    """Names and values of the attributes of a plain tag."""
    return tuple((name.lower(), unescape(value)) for name, value in _PLAIN_ATTR.findall(text))


def parse(html: str | None) -> Node:
    """The page's tree; of a page that the parser gives up on, the part before."""
    builder = _Builder()
    try:
        builder.read(html or "")
    except (AssertionError, RecursionError):
        pass
    return builder.root


@lru_cache(maxsize=512)
def _compile(selector: str):
    """``a.b[x^=y] > c d`` as a list of (step test, is direct child)."""
    plan, child = [], False
    for token in re.findall(r">|(?:[^\s>\[]|\[[^\]]*\])+", selector):
        if token == ">":
            child = True
            continue
        tag, classes, ident, attrs = _STEP.fullmatch(token).groups()
        plan.append(
            (
                tag.lower(),
                tuple(c for c in classes.split(".") if c),
                (ident or "")[1:],
                tuple(_ATTR.findall(attrs or "")),
                child,
            )
        )
        child = False
    return tuple(plan)


def _step_ok(node: Node, step) -> bool:
    tag, classes, ident, attrs, _ = step
    if tag and node.tag != tag:
        return False
    if classes:
        own = node.attr("class").split()
        if not all(c in own for c in classes):
            return False
    if ident and node.attr("id") != ident:
        return False
    for name, operator, value in attrs:
        if name not in node.attrs:
            return False
        held = node.attr(name)
        if operator == "=" and held != value:
            return False
        if operator == "*=" and value not in held:
            return False
        if operator == "^=" and not held.startswith(value):
            return False
    return True


def _fits_any(node: Node, steps) -> bool:
    for step in steps:
        attrs = step[3]
        if (not attrs or attrs[0][0] in node.attrs) and _step_ok(node, step):
            return True
    return False


def _matches(node: Node, plan) -> bool:
    """Whether the node and a chain of elements above it fit the steps, the last step first."""
    if not _step_ok(node, plan[-1]):
        return False
    # The chains found so far, each as the element it has reached; a step that may skip elements
    # goes on from the nearest one that fits and, if that leads nowhere, from those above it.
    waiting = [(node, len(plan) - 1)]
    seen = set()
    while waiting:
        current, at = waiting.pop()
        if at == 0:
            return True
        for above in current.ancestors(1 if plan[at][4] else None):
            if (above.place, at) in seen:
                break
            if _step_ok(above, plan[at - 1]):
                waiting.append((above, at - 1))
            if not plan[at][4]:
                seen.add((above.place, at))
    return False


def image_sources(node: Node, *attributes: str):
    """First entry of every image attribute below a node, inline data left out."""
    for image in node.matching("img"):
        value = next((image.attr(a) for a in attributes if image.attr(a)), "")
        entry = value.split()[0].rstrip(",") if value.split() else ""
        if entry and not entry.startswith("data:"):
            yield entry
