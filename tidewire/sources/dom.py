"""A small element tree from stdlib ``html.parser``, for page scanners that run in Arrow functions."""

from collections.abc import Iterator
from html.parser import HTMLParser

from tidewire.functions.text import clean_text

VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])


class Node:
    """An element: name, attributes, parent, and children that are elements or strings."""

    def __init__(self, name: str, attrs: dict[str, str], parent: "Node | None"):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self) -> Iterator["Node"]:
        """All elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def all(self, *names: str) -> list["Node"]:
        return [n for n in self.walk() if n.name in names]

    def first(self, *names: str) -> "Node | None":
        return next((n for n in self.walk() if n.name in names), None)

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def inside(self, *names: str) -> bool:
        return any(p.name in names for p in self.parents())

    def parents(self) -> Iterator["Node"]:
        p = self.parent
        while p is not None and p.name:
            yield p
            p = p.parent

    def strings(self, hidden: bool = False) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif hidden or c.name not in ("script", "style"):
                yield from c.strings(hidden)

    def text(self) -> str:
        """Text of the parts below, one space between them, cleaned."""
        return clean_text(" ".join(x for s in self.strings() if (x := s.strip())))

    def raw(self) -> str:
        return "".join(self.strings(True))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.name != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(markup: str) -> Node:
    b = _Builder()
    b.feed(markup)
    b.close()
    return b.root
