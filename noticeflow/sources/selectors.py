"""Declared extraction from pages by selectors: a tree of the page, and compiled paths of tags, classes, ids and attributes."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: What a start tag closes before it, up to an element that bounds it.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "p": ({"p"}, {"div", "td", "li", "article", "section", "body"}), "option": ({"option"}, {"select"})}
_SIMPLE = re.compile(r"(?P<tag>[A-Za-z][\w-]*|\*)?(?P<rest>(?:[.#][\w-]+|\[[^\]]+\])*)$")
_PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w:-]+)\s*(?:(\^=|\$=|\*=|~=|=)\s*\"?'?([^\"'\]]*)\"?'?)?\s*\]")
_COLUMN = re.compile(r"table::column\((\d+)\)$")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str]
    parent: Node | None = None
    children: list = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """Elements below, in the page's order."""
        stack = [x for x in reversed(self.children) if isinstance(x, Node)]
        while stack:
            now = stack.pop()
            yield now
            stack += [x for x in reversed(now.children) if isinstance(x, Node)]

    def text(self) -> str:
        """All text below, white space collapsed; scripts and styles left out."""
        out, stack = [], list(reversed(self.children))
        while stack:
            now = stack.pop()
            if isinstance(now, str):
                out.append(now)
            elif now.tag not in ("script", "style"):
                out.append(" " if now.tag in ("br", "p", "div", "li", "tr", "td", "th") else "")
                stack += reversed(now.children)
        return " ".join("".join(out).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {})

    def handle_starttag(self, tag, attrs):
        closes, bounds = _CLOSES.get(tag, ((), ()))
        above, last = self.now, None
        while above is not None and above.tag not in bounds:
            if above.tag in closes:
                last = above
            above = above.parent
        self.now = last.parent if last is not None else self.now
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in _EMPTY:
            self.now = node

    def handle_endtag(self, tag):
        at = self.now
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            self.now = at.parent

    def handle_data(self, data):
        self.now.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; what is not closed ends where it must."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


class Selector:
    """``a, b`` of steps joined by blanks (below) or ``>`` (directly below); a step is tag, .class, #id and [attribute],
    [attribute=value], with ^= $= *= ~= for its start, end, a part, a word."""

    def __init__(self, source: str):
        self.paths = [self._path(x.strip()) for x in source.split(",")]

    def _path(self, source: str) -> list[tuple[str, object]]:
        out, direct = [], " "
        tokens = re.findall(r"(?:[^\s>\[]|\[[^\]]*\])+|>", source)
        if "".join(tokens) != re.sub(r"\[[^\]]*\]|\s", lambda m: m[0].strip(), source) or tokens[-1:] == [">"]:
            raise ValueError(f"selector {source!r}")
        for token in tokens:
            if token == ">":
                if direct == ">":
                    raise ValueError(f"selector {source!r}")
                direct = ">"
                continue
            m = _SIMPLE.match(token)
            if not m:
                raise ValueError(f"selector {token!r}")
            tests = [(a or b, c or None, d, e) for a, c, b, d, e in ((x[0], x[1], x[2], x[3], x[4]) for x in _PART.findall(m["rest"]))]
            out.append((direct, (m["tag"] or "*").lower(), tests))
            direct = " "
        if not out:
            raise ValueError("empty selector")
        return out

    @staticmethod
    def _fits(node: Node, step: tuple) -> bool:
        _, tag, tests = step
        if tag not in ("*", node.tag):
            return False
        for kind, name, op, value in tests:
            if kind == ".":
                fits = name in node.attributes.get("class", "").split()
            elif kind == "#":
                fits = node.attributes.get("id") == name
            else:
                held = node.attributes.get(kind)
                fits = held is not None and {"": True, "=": held == value, "^=": held.startswith(value), "$=": held.endswith(value), "*=": value in held, "~=": value in held.split()}[op]
            if not fits:
                return False
        return True

    def _reached(self, node: Node, path: list, k: int, scope: Node) -> bool:
        if not self._fits(node, path[k]):
            return False
        if k == 0:
            return path[0][0] == " " or node.parent is scope
        above = node.parent
        while above is not None and above.tag:
            if self._reached(above, path, k - 1, scope):
                return True
            if path[k][0] == ">" or above is scope:
                return False
            above = above.parent
        return False

    def select(self, scope: Node) -> Iterator[Node]:
        return (n for n in scope.walk() if any(self._reached(n, p, len(p) - 1, scope) for p in self.paths))


class Place:
    """``table::column(n)`` (from 0, of a table's row), or a selector with ``@attribute`` or ``::text``."""

    def __init__(self, source: str):
        self.column = int(m[1]) if (m := _COLUMN.match(source)) else None
        base = source.removesuffix("::text")
        selector, _, self.attribute = base.partition("@") if "@" in base and "[" not in base.rpartition("@")[2] else (base, "", "")
        self.selector = Selector(selector) if self.column is None else None

    def value(self, scope: Node) -> str | None:
        if self.column is not None:
            cells = [n for n in scope.walk() if n.tag == "td"] if scope.tag == "tr" else []
            return cells[self.column].text() or None if self.column < len(cells) else None
        node = next(self.selector.select(scope), None)
        if node is None:
            return None
        return (" ".join(node.attributes.get(self.attribute, "").split()) if self.attribute else node.text()) or None


def selected_rows(identifier: str, mapping: Mapping[str, str], rows: tuple[str, ...] = ("tr", "li", "article")):
    """A column function: of a page, one map per row that holds the ``identifier`` place: its fields by ``mapping``, and
    ``id``. A row is the nearest of ``rows`` around a hit; rows without an identifier go, and of an identifier the first
    stays. Selectors are compiled once; a bad one is an error before any page is read."""
    key = Place(identifier)
    hits = Selector("tr") if key.column is not None else key.selector
    places = {k: Place(v) for k, v in mapping.items()}

    @F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    def extract(pages: pd.Series) -> pd.Series:
        def one(html):
            out, seen = {}, set()
            for node in hits.select(parse(html)):
                while node is not None and node.tag not in rows:
                    node = node.parent
                if node is None or id(node) in seen:
                    continue
                seen.add(id(node))
                name = key.value(node)
                if name is not None and name not in out:
                    out[name] = {"id": name} | {k: p.value(node) for k, p in places.items()}
            return list(out.values())

        return pages.map(one)

    return extract
