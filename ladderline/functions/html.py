"""A small element tree over the standard tokenizer, and the part of CSS selectors that ranking pages need."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_HIDDEN = frozenset(("script", "style", "template"))


@dataclass(eq=False)
class Element:
    """An element with its place in document order; its descendants are numbers start + 1 to end."""

    tag: str
    attrs: dict[str, str]
    parent: Element | None
    start: int
    end: int = 0
    content: list[Element | str] = field(default_factory=list)

    def descendants(self) -> Iterator[Element]:
        todo = [x for x in reversed(self.content) if isinstance(x, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo += [x for x in reversed(e.content) if isinstance(x, Element)]

    def contains(self, other: Element) -> bool:
        return self.start < other.start <= self.end

    def text(self) -> str:
        """All text in it, without that of scripts, styles and templates further down."""
        out, todo = [], list(reversed(self.content))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in _HIDDEN:
                todo += reversed(x.content)
        return "".join(out)

    def select(self, selector: str) -> list[Element]:
        return [e for e in self.descendants() if matches(e, selector)]

    def first(self, selector: str) -> Element | None:
        return next((e for e in self.descendants() if matches(e, selector)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None, 0)
        self.count = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.count += 1
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at, self.count, self.count)
        self.at.content.append(e)
        if tag not in _VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:  # an end tag that nothing opened is left out
            self._close_to(e.parent)

    def _close_to(self, outer: Element) -> None:
        while self.at is not outer:
            self.at.end = self.count
            self.at = self.at.parent

    def handle_data(self, data: str) -> None:
        self.at.content.append(data)


def parse_html(html: str) -> Element:
    """The tree; tags left open end with their parent."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder._close_to(builder.root)
    builder.root.end = builder.count
    return builder.root


_PART = re.compile(r"""(?P<tag>[\w-]+|\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>\*?=)\s*["']?(?P<value>[^"'\]]*)["']?\s*)?\]|:has\((?P<has>(?:[^()]|\([^()]*\))*)\)""")


@lru_cache(maxsize=512)
def _compiled(selector: str) -> tuple[tuple[tuple[tuple[str, str, str], ...], ...], ...]:
    """Alternatives; each a chain of ancestors down to the element; each of those a list of tests."""
    out = []
    for alternative in re.split(r",(?![^(\[]*[)\]])", selector):
        chain, at, tests = [], 0, []
        text = alternative.strip()
        while at < len(text):
            if text[at].isspace():
                if tests:
                    chain.append(tuple(tests))
                tests, at = [], at + 1
                continue
            if not (m := _PART.match(text, at)):
                raise ValueError(f"unsupported selector: {selector}")
            at = m.end()
            kind = m.lastgroup if m["attr"] is None else "attr"
            tests.append((m["op"] or "has_attr", m["attr"], m["value"] or "") if kind == "attr" else (kind, m[kind], ""))
        out.append((*chain, tuple(tests)))
    return tuple(out)


def _passes(e: Element, test: tuple[str, str, str]) -> bool:
    kind, name, value = test
    if kind == "tag":
        return name in ("*", e.tag)
    if kind == "id":
        return e.attrs.get("id") == name
    if kind == "cls":
        return name in e.attrs.get("class", "").split()
    if kind == "has":
        return e.first(name) is not None
    found = e.attrs.get(name)
    return found is not None and (kind == "has_attr" or (value == found if kind == "=" else bool(value) and value in found))


def matches(e: Element, selector: str) -> bool:
    for chain in _compiled(selector):
        if all(_passes(e, t) for t in chain[-1]):
            left, up = len(chain) - 2, e.parent
            while left >= 0 and up is not None:
                left -= all(_passes(up, t) for t in chain[left]) and bool(up.tag)
                up = up.parent
            if left < 0:
                return True
    return False
