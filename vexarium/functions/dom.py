"""A small DOM over the standard library's HTML parser, with the few searches that page parsers need."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style", "template", "noscript"))
_BREAKS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",), "option": ("option",)}
HEADERS = ("h1", "h2", "h3", "h4", "h5", "h6")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "parts")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.parts: list[str | Node] = []

    def walk(self) -> Iterator[Node]:
        """This node and all below it in document order; iterative, so depth is no limit."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def text(self) -> str:
        out: list[str] = []
        stack: list[str | Node] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in _SILENT:
                out.append(" ")
                stack.append(" ")
                stack.extend(reversed(x.parts))
        return _SPACE.sub(" ", "".join(out)).strip()

    def own_text(self) -> str:
        return _SPACE.sub(" ", "".join(p for p in self.parts if isinstance(p, str))).strip()

    def find(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if n is not self and test(n)]

    def tags(self, *names: str) -> list[Node]:
        return self.find(lambda n: n.tag in names)

    def has(self, attr: str, part: str) -> bool:
        return part in self.attrs.get(attr, "")

    def next(self) -> Node | None:
        if self.parent is None:
            return None
        sib = self.parent.children
        i = next(k for k, n in enumerate(sib) if n is self) + 1
        return sib[i] if i < len(sib) else None

    def up(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BREAKS:  # an open sibling ends where the next begins, unless a list or table lies between
            n: Node | None = self.at
            while n is not None and n.tag not in ("ul", "ol", "dl", "table", "div", "body", "#root"):
                if n.tag in _BREAKS[tag] and n.parent is not None:
                    self.at = n.parent
                n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        self.at.parts.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        self.at.parts.append(node)

    def handle_endtag(self, tag: str) -> None:
        n: Node | None = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


@contextmanager
def parsed(html: str | None) -> Iterator[Node]:
    """The page's tree, cut apart at the end: parents and children hold each other, so a tree would else live until the cycle collector comes by."""
    root = parse(html)
    try:
        yield root
    finally:
        stack = [root]
        while stack:
            n = stack.pop()
            stack.extend(n.children)
            n.parent = None
            n.children.clear()
            n.parts.clear()


def section(root: Node, label: str, stop: Callable[[Node], bool] | None = None) -> str:
    """The text after the first header, term or bold label that contains `label` (in any case), up to the next of its kind."""
    low = label.lower()
    for n in root.find(lambda n: n.tag in (*HEADERS, "dt", "th", "strong", "b", "td", "label")):
        t = n.text()
        if low in t.lower() and len(t) <= 4 * len(label) + 40:
            holder = n
            while holder.next() is None and holder.parent is not None and holder.parent.tag in ("strong", "b", "p", "span", "div") and holder.parent.text() == t:
                holder = holder.parent
            rest = ""
            if n.tag in ("strong", "b", "label") and n.parent is not None:  # the label's own line
                rest = n.parent.text().partition(t)[2].strip(" :")
            if rest:
                return rest
            out, x = [], holder.next()
            while x is not None and x.tag != holder.tag and x.tag not in HEADERS and not (stop and stop(x)):
                out.append(x.text())
                if n.tag in ("dt", "th", "td"):
                    break
                x = x.next()
            if any(out):
                return " ".join(o for o in out if o)
    return ""
