"""A forgiving HTML parser that keeps what the extractor needs of the tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: In what these hold, "/>" ends a raw element too.
FOREIGN = frozenset("svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul button label".split()
)
#: An opening tag on the left ends open elements on the right, up to a limit.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_ENDERS = BLOCK - {"html", "head", "body", "tr", "td", "th", "tbody", "thead", "tfoot", "button", "label", "option", "legend", "summary"}
_P_LIMIT = frozenset("td th table button body html".split())

#: A whole tag without "<" or ">" inside; nothing is tried twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*+)([^<>\"']*+(?:(?:\"[^\"<>]*+\"|'[^'<>]*+')[^<>\"']*+)*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"[>\"']")
_ANGLE = re.compile(r"[<>]")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    names: str = ""
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    """Nodes in page order (0 is the root) and blocks of (node, text) pieces."""

    nodes: list[Node]
    blocks: list[list[tuple[int, str]]]


class _Tags:
    """Where tags end, from left to right, each character read a bounded number of times.

    A tag ends at the first ">" outside quotes.  Where quotes leave none, it ends
    at the next ">" or before the next tag if a quote stands before that, and is
    text otherwise.  Places whose quotes lead to no end are remembered, as later
    tags come by the same ones.
    """

    def __init__(self, html: str):
        self.html = html
        self._last = {mark: html.rfind(mark) for mark in "\"'>"}
        self._lost: set[int] = set()
        self._near = (0, -1)  # no special mark between these two

    def _special(self, at: int) -> int:
        found = _SPECIAL.search(self.html, at)
        return found.start() if found else len(self.html)

    def _end(self, at: int) -> int:
        """The ">" that ends a tag whose attributes begin here; -1 if there is none."""
        html, path = self.html, []
        low, high = self._near
        if not low <= at <= high:
            high = self._special(at)
            self._near = (at, high)
        place = high
        while place < len(html) and place not in self._lost:
            mark = html[place]
            if mark == ">":
                return place
            path.append(place)
            if place >= self._last[mark]:
                break
            place = self._special(html.index(mark, place + 1) + 1)
        self._lost.update(path)
        return -1

    def at(self, place: int) -> tuple[int, bool, str, str, bool] | None:
        """(end, closing, name, attributes, self-closed) of the tag at a "<"; None if it is text."""
        whole = _TAG.match(self.html, place)
        if whole:
            inner = whole[3]
            closed = inner.endswith("/")
            return whole.end(), bool(whole[1]), whole[2].lower(), inner[:-1] if closed else inner, closed
        name = _NAME.match(self.html, place)
        if not name:
            return None
        end = self._end(name.end())
        after = end + 1
        if end < 0:
            angle = _ANGLE.search(self.html, name.end())
            if not angle:
                return None
            end = angle.start()
            part = self.html[name.end() : end]
            if '"' not in part and "'" not in part:
                return None
            after = end + (self.html[end] == ">")
        inner = self.html[name.end() : end]
        closed = inner.endswith("/")
        return after, bool(name[1]), name[2].lower(), inner[:-1] if closed else inner, closed

    def after_raw(self, tag: str, at: int) -> int:
        """Behind the end tag of a raw element; the end of the page without one."""
        found = re.compile("</" + re.escape(tag), re.IGNORECASE).search(self.html, at)
        return self.html.index(">", found.end()) + 1 if found and found.end() <= self._last[">"] else len(self.html)

    def after_remark(self, at: int) -> int:
        """Behind a comment or declaration."""
        mark = "-->" if self.html.startswith("<!--", at) else ">"
        end = self.html.find(mark, at + (4 if mark == "-->" else 2)) if at < self._last[">"] else -1
        return end + len(mark) if end >= 0 else len(self.html)


class _Open:
    """The open elements, and for each tag where it stands among them."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack = nodes, [0]
        self.places: dict[str, list[int]] = {}

    def push(self, node: int) -> None:
        tag = self.nodes[node].tag
        held = self.places.get(tag)
        if held is None:
            held = self.places[tag] = []
        held.append(len(self.stack))
        self.stack.append(node)

    def cut(self, place: int) -> None:
        nodes, places = self.nodes, self.places
        for node in self.stack[place:]:
            places[nodes[node].tag].pop()
        del self.stack[place:]

    def last(self, tags) -> int:
        """The innermost open element of these tags; 0 for none."""
        last, places = 0, self.places
        for tag in tags:
            held = places.get(tag)
            if held and held[-1] > last:
                last = held[-1]
        return last

    def close(self, tags, limit=frozenset()) -> None:
        """Ends open elements down to the innermost of ``tags``, unless a limit lies above it."""
        place = self.last(tags)
        if place and place > self.last(limit):
            self.cut(place)


def parse(html: str) -> Page:
    nodes, blocks, block = [Node("#root", -1, 0)], [], []
    opened, tags = _Open(nodes), _Tags(html)

    def text(piece: str) -> None:
        if piece:
            block.append((opened.stack[-1], piece))

    def flush() -> None:
        nonlocal block
        if any(piece.strip() for _, piece in block):
            blocks.append(block)
        block = []

    begin, at, end = 0, html.find("<"), len(html)
    while 0 <= at < end:
        if html.startswith(("<!", "<?"), at):
            text(html[begin:at])
            begin = tags.after_remark(at)
            at = html.find("<", begin)
            continue
        found = tags.at(at)
        if found is None:
            at = html.find("<", at + 1)
            continue
        text(html[begin:at])
        begin, closing, tag, inner, closed = found
        if tag in BLOCK:
            flush()
        elif tag == "br":
            text(" ")
        if closing:
            if tag not in VOID:
                opened.close({tag})
        elif tag in RAW and not (closed and opened.last(FOREIGN)):
            begin = tags.after_raw(tag, begin)
        else:
            if tag in _P_ENDERS:
                opened.close({"p"}, _P_LIMIT)
            if tag in _ENDS:
                opened.close(*_ENDS[tag])
            names = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(inner)) if inner else ""
            parent = opened.stack[-1]
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, names))
            nodes[parent].children.append(len(nodes) - 1)
            if tag not in VOID and not closed:
                opened.push(len(nodes) - 1)
        at = html.find("<", begin)
    text(html[begin:])
    flush()
    return Page(nodes, blocks)
