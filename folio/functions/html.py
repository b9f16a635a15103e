"""HTML as a tree of elements, for functions that run in Python inside tasks. Nothing here recurses, as pages may nest deeply."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def below(self, hidden=()) -> Iterator[Element]:
        """The element and all below it in document order, without those of hidden tags."""
        waiting = [self]
        while waiting:
            own = waiting.pop()
            yield own
            waiting += [c for c in reversed(own.children) if isinstance(c, Element) and c.tag not in hidden]

    def first(self, *tags: str, **attrs: str) -> Element | None:
        """The first element below with one of the tags and the attributes; class is one of the classes."""

        def fits(e: Element) -> bool:
            return e.tag in tags and all(v in (e.attrs.get(k) or "").split() if k == "class" else e.attrs.get(k) == v for k, v in attrs.items())

        return next((e for e in self.below() if e is not self and fits(e)), None)

    def text(self, joint: str = " ", hidden=()) -> str:
        """Texts below, each trimmed, joined."""
        out, waiting = [], [self]
        while waiting:
            own = waiting.pop()
            if isinstance(own, str):
                if own.strip():
                    out.append(own.strip())
            elif own is self or own.tag not in hidden:
                waiting += reversed(own.children)
        return joint.join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Element("", {})]

    def handle_starttag(self, tag, attrs):
        self.handle_startendtag(tag, attrs)
        if tag not in VOID:
            self.open.append(self.open[-1].children[-1])

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Element(tag, dict(attrs)))

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parsed(html: str | None) -> Element:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.open[0]
