"""A small document tree on the standard library's HTML parser, with the selectors the page extraction needs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def texts(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            else:
                yield from c.texts()

    def own_texts(self) -> list[str]:
        return [c for c in self.children if isinstance(c, str)]

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "p":
            self._close("p", {"div", "article", "main", "section", "body", "li", "td"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def _close(self, tag: str, stop: set[str]) -> None:
        n = self.at
        while n.parent is not None and n.tag not in stop:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_endtag(self, tag: str) -> None:
        self._close(tag, set())

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_PART = re.compile(r"([a-z0-9]+|\*)|\.([\w-]+)|\[([\w-]+)(?:(\*?=)['\"]?([^'\"\]]*)['\"]?)?\]|:(first-of-type)|:has\((\w+)\)")


@lru_cache(maxsize=256)
def _compiled(selector: str) -> tuple:
    out = []
    for one in selector.split(","):
        steps = []
        for compound in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", one.strip()):
            steps.append(tuple(m.groups() for m in _PART.finditer(compound)))
        out.append(tuple(steps))
    return tuple(out)


def _fits(n: Node, compound: tuple) -> bool:
    for tag, cls, attr, op, value, first, has in compound:
        if tag and tag != "*" and n.tag != tag:
            return False
        if cls and cls not in (n.get("class") or "").split():
            return False
        if attr:
            have = n.get(attr)
            if have is None or (op == "*=" and value not in have) or (op == "=" and value != have):
                return False
        if first and n.parent is not None and next((c for c in n.parent.children if isinstance(c, Node) and c.tag == n.tag), None) is not n:
            return False
        if has and not any(c.tag == has for c in n.walk()):
            return False
    return True


def _chain(n: Node, steps: tuple, within: Node) -> bool:
    if not _fits(n, steps[-1]):
        return False
    k, up = len(steps) - 2, n.parent
    while k >= 0:
        while up is not None and up is not within and not _fits(up, steps[k]):
            up = up.parent
        if up is None or up is within:
            return False
        k, up = k - 1, up.parent
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Descendants of ``root`` that fit any of the comma-separated selectors, in document order."""
    alternatives = _compiled(selector)
    return [n for n in root.walk() if any(_chain(n, steps, root) for steps in alternatives)]


def clean(parts) -> str | None:
    value = " ".join(" ".join(p.split()) for p in parts if p.strip())
    return " ".join(value.split()) or None


def text_of(n: Node) -> str | None:
    return clean(n.texts())
