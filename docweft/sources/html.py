"""HTML to elements with the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import elements

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROP = {"script", "style", "noscript"}
_SPACE = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict | None = None, parent: _Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def strings(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, _Node):
                yield from c.strings()
            elif not isinstance(c, _Comment):
                yield c

    def text(self) -> str:
        return " ".join(s.strip() for s in self.strings() if s.strip())

    def all(self, *tags: str) -> Iterator[_Node]:
        for c in self.children:
            if isinstance(c, _Node):
                if c.tag in tags:
                    yield c
                yield from c.all(*tags)


class _Comment(str):
    """A comment is read as text where it is a child that is walked, and as nothing within a paragraph."""


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("root")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, {k: v for k, v in attrs if v is not None}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(_Node(tag, {k: v for k, v in attrs if v is not None}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node: _Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if self.at.children and type(self.at.children[-1]) is str:
            self.at.children[-1] += data
        else:
            self.at.children.append(data)

    def handle_comment(self, data: str) -> None:
        self.at.children.append(_Comment(data))


def parse(html: str) -> list[dict]:
    """Elements of one page, without ids."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    body = next(tree.root.all("body"), tree.root)
    out: list[dict] = []

    def add(kind: str, content: str = "", **more) -> None:
        out.append({"type": kind, "content": content, "level": None, "items": None, "rows": None} | more)

    work = list(reversed(body.children))
    while work:
        node = work.pop()
        if not isinstance(node, _Node):
            if node.strip():
                add("paragraph", node.strip())
        elif node.tag in _DROP:
            continue
        elif re.fullmatch("h[1-6]", node.tag):
            add("heading", node.text(), level=int(node.tag[1]))
        elif node.tag == "p":
            if node.text():
                add("paragraph", node.text())
        elif node.tag in ("ul", "ol"):
            items = [c.text() for c in node.children if isinstance(c, _Node) and c.tag == "li"]
            if items:
                add("bullet_list" if node.tag == "ul" else "numbered_list", items=items)
        elif node.tag == "table":
            rows = [[c.text() for c in tr.all("td", "th")] for tr in node.all("tr")]
            add("table", rows=[r for r in rows if r])
        elif node.tag in ("caption", "figcaption"):
            add("caption", node.text())
        elif node.tag == "img":
            if (node.attrs.get("alt") or "").strip():
                add("image_caption", node.attrs["alt"].strip())
        else:
            work.extend(reversed(node.children))
    return out


def parse_html(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Elements of pages. Nothing is shuffled; a page that can't be read has no elements. A null key reads as such."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"doc_id": k, "ord": i, "page_start": 1, "page_end": 1} | e for k, h in zip(b["doc_id"], b["html"]) for i, e in enumerate(parse(h))]
            if rows:
                yield pd.DataFrame(rows, columns=elements.NAMES).astype({"level": "Int32"})

    return pages.select(F.col(key).cast("string").alias("doc_id"), F.col(html).alias("html")).mapInPandas(run, elements.SCHEMA)
