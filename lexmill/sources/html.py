"""Readable text out of HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_DROPPED = {"title", "hr", "img"}


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def handle_entityref(self, name):
        self.open[-1].children.append(f"&{name};")

    def handle_charref(self, name):
        self.open[-1].children.append(f"&#{name};")


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def inner_text(node: Node) -> str:
    """All text below a node; by a stack, as pages nest as deep as they like."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack += x.children[::-1]
    return "".join(out)


def text_of(node: Node) -> str:
    """Text as read: annotated words without their readings, br as a line break, one behind each paragraph.

    Entities stay as they are written; titles, rules, images and comments are left out.
    """
    out: list[str] = []
    stack: list = [*node.children[::-1]]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "ruby":
            out += [c if isinstance(c, str) else inner_text(c) for c in x.children if isinstance(c, str) or c.tag == "rb"]
        elif x.tag == "br":
            out.append("\n")
        elif x.tag not in _DROPPED:
            if x.tag == "p":
                stack.append("\n")
            stack += x.children[::-1]
    return "".join(out)


def lines_of(html: str) -> list[str]:
    """The lines of each top-level element, each with its line break."""
    return [line + "\n" for top in parse(html).children if isinstance(top, Node) for line in text_of(top).split("\n")]


def page_lines(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, line_index, line) of every page; null html has no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, lines = [], [], []
            for k, html in zip(batch.column("k").to_pylist(), batch.column("h").to_pylist()):
                found = lines_of(html or "")
                ids += [k] * len(found)
                numbers += range(len(found))
                lines += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(lines, pa.string())], ["page_id", "line_index", "line"])

    return pages.selectExpr(f"cast(`{id_col}` as long) as k", f"`{html_col}` as h").mapInArrow(run, "page_id long, line_index int, line string")
