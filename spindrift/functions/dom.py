"""A small document tree on the standard library's parser, for page operators.

Elements that are left open contain what follows, void elements contain nothing; no element is closed by implication.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Element:
    __slots__ = ("tag", "attrs", "parent", "kids")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Element | str] = []

    @property
    def classes(self) -> str:
        return " ".join(self.attrs.get("class", "").split())

    def walk(self) -> Iterator[Element]:
        """This element's descendants in document order."""
        todo = [k for k in reversed(self.kids) if isinstance(k, Element)]
        while todo:
            x = todo.pop()
            yield x
            todo.extend(k for k in reversed(x.kids) if isinstance(k, Element))

    def all(self, tags: str | None = None, test: Callable[[Element], bool] | None = None) -> Iterator[Element]:
        names = tags.split() if tags else None
        return (x for x in self.walk() if (names is None or x.tag in names) and (test is None or test(x)))

    def first(self, tags: str | None = None, test: Callable[[Element], bool] | None = None) -> Element | None:
        return next(self.all(tags, test), None)

    def text(self, between: str = "") -> str:
        out, todo = [], list(reversed(self.kids))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(reversed(x.kids))
        return between.join(out)

    def up(self, tags: str) -> Element | None:
        names, x = tags.split(), self.parent
        while x is not None and x.tag not in names:
            x = x.parent
        return x

    def after(self) -> Iterator[Element]:
        """The siblings that follow."""
        kids = self.parent.kids if self.parent else []
        at = next(i for i, k in enumerate(kids) if k is self) if kids else 0
        return (k for k in kids[at + 1 :] if isinstance(k, Element))

    def before(self) -> Iterator[Element]:
        kids = self.parent.kids if self.parent else []
        at = next(i for i, k in enumerate(kids) if k is self) if kids else 0
        return (k for k in kids[:at] if isinstance(k, Element))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        x = Element(tag, seen, self.at)
        self.at.kids.append(x)
        if tag not in VOID:
            self.at = x

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        x = self.at
        while x is not self.root and x.tag != tag:
            x = x.parent
        if x is not self.root:
            self.at = x.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str | None) -> Element:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root
