"""A page's elements and descendant selectors such as '.info .content li a', for user jobs."""

from __future__ import annotations

from html.parser import HTMLParser

# Fixed names: elements without content, and elements that end an open one of the same name.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SELF_ENDING = {"p", "li", "dt", "dd", "option", "tr", "td", "th"}


class Element:
    def __init__(self, tag: str, attrs: dict, parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                out.append(e)
            else:
                todo.extend(reversed(e.children))
        return "".join(out)

    def descendants(self):
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def matches(self, simple: str) -> bool:
        tag, *classes = simple.split(".")
        own = (self.attrs.get("class") or "").split()
        return (not tag or tag == self.tag) and all(c in own for c in classes)

    def select(self, selector: str) -> list[Element]:
        *above, last = selector.split()
        return [e for e in self.descendants() if e.matches(last) and e._inside(above)]

    def _inside(self, above: list[str]) -> bool:
        need = list(above)
        up = self.parent
        while need and up is not None:
            if up.matches(need[-1]):
                need.pop()
            up = up.parent
        return not need


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in SELF_ENDING and self.open.tag == tag:
            self.open = self.open.parent
        first = {}
        for k, v in attrs:
            first.setdefault(k, v)
        e = Element(tag, first, self.open)
        self.open.children.append(e)
        if tag not in VOID:
            self.open = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open = self.open.parent

    def handle_endtag(self, tag):
        e = self.open
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.open = e.parent

    def handle_data(self, data):
        self.open.children.append(data)


def tree(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
