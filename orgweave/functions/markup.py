"""A page's elements as a small tree, for rules that ask what stands around a link or within a card.

Elements nest as they are written; an end tag closes what was opened since its start tag, and is
ignored if there is none. Text of scripts, styles and templates is no text of what encloses them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CODE = {"script", "style", "template"}


class Element:
    __slots__ = ("tag", "attributes", "parent", "parts")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.parts: list[Element | str] = []

    def has_class(self, name: str) -> bool:
        return name in self.attributes.get("class", "").split()

    def walk(self) -> Iterator[Element]:
        """The elements within, in page order."""
        todo = [x for x in reversed(self.parts) if isinstance(x, Element)]
        while todo:
            x = todo.pop()
            yield x
            todo += [y for y in reversed(x.parts) if isinstance(y, Element)]

    def strings(self) -> Iterator[str]:
        todo: list[Element | str] = list(reversed(self.parts))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in _CODE:
                todo += reversed(x.parts)

    def text(self, limit: int | None = None) -> str:
        """Its strings, trimmed and joined by spaces, as far as `limit` characters."""
        out, size = [], 0
        for x in self.strings():
            if x := x.strip():
                out.append(x)
                size += len(x) + 1
                if limit is not None and size > limit:
                    break
        return " ".join(out)[:limit]

    def above(self, fits: Callable[[Element], bool]) -> Element | None:
        x = self.parent
        while x is not None and not fits(x):
            x = x.parent
        return x


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        x = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(x)
        if tag not in _VOID:
            self.at = x
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.at.parts.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        while self.open.get(tag):
            self.open[self.at.tag] -= 1
            closed, self.at = self.at, self.at.parent
            if closed.tag == tag:
                break

    def handle_data(self, data):
        self.at.parts.append(data)


def tree(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def clean(value: str | None) -> str:
    """Without control characters, white space as one space."""
    return re.sub(r"\s+", " ", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", value or "")).strip()
