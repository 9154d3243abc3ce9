"""Electronic books: chapters and lines out of EPUB archives."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import urllib.parse
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.html import Node, inner_text, lines_of, parse

#: What a title is cleaned of: brackets, wave dashes, and all behind a full stop or a wide space.
_TITLE = re.compile(r"(～.+～)|(\(.+\))|(（.+）)|(【.+】)|(。.*$)|(　.*$)")


class NoChapters(ValueError):
    pass


@dataclass
class Chapter:
    title: str
    start_pos: int
    length: int
    lines: list[str]


@dataclass
class Book:
    title: str
    chapters: list[Chapter]
    file_hash: str
    images_hash: str

    def raw_text(self) -> str:
        """All lines, with one more line break each."""
        return "".join(line + "\n" for c in self.chapters for line in c.lines)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


class _Archive:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        container = ET.fromstring(self.zip.read("META-INF/container.xml"))
        self.opf = next(x.attrib["full-path"] for x in container.iter() if _local(x.tag) == "rootfile")
        self.folder = posixpath.dirname(self.opf)
        root = ET.fromstring(self.zip.read(self.opf))
        self.title = next((x.text or "" for x in root.iter() if _local(x.tag) == "title"), None)
        items = [x for x in root.iter() if _local(x.tag) == "item"]
        self.resources = {x.attrib["id"]: self.path(x.attrib["href"]) for x in items}
        self.kinds = {x.attrib["id"]: x.attrib.get("media-type", "") for x in items}
        spine = next((x for x in root.iter() if _local(x.tag) == "spine"), None)
        self.spine = [x.attrib["idref"] for x in spine if _local(x.tag) == "itemref"] if spine is not None else []
        self.toc_id = spine.attrib.get("toc") if spine is not None else None
        self.pages = [self.resources[i] for i in self.spine if i in self.resources]

    def path(self, href: str, base: str | None = None) -> str:
        return posixpath.normpath(posixpath.join(self.folder if base is None else base, urllib.parse.unquote(href)))

    def text(self, path: str) -> str:
        return self.zip.read(path).decode("utf-8", "replace")

    def toc(self) -> list[tuple[str, str]]:
        """(label, path) of the top entries of the table of contents."""
        toc_id = self.toc_id or next((i for i, kind in self.kinds.items() if kind == "application/x-dtbncx+xml"), None)
        if toc_id not in self.resources:
            return []
        path = self.resources[toc_id]
        nav_map = next((x for x in ET.fromstring(self.zip.read(path)).iter() if _local(x.tag) == "navMap"), None)
        out = []
        for point in nav_map if nav_map is not None else []:
            if _local(point.tag) == "navPoint":
                label = next((x.text or "" for x in point.iter() if _local(x.tag) == "text"), "")
                src = next((x.attrib["src"] for x in point if _local(x.tag) == "content"), None)
                if src is not None:
                    out.append((label, self.path(src, posixpath.dirname(path))))
        return out

    def nav(self) -> list[tuple[str, str]]:
        if "nav" not in self.resources:
            return []
        path, out, stack = self.resources["nav"], [], [parse(self.text(self.resources["nav"]))]
        while stack:
            x = stack.pop()
            if x.tag == "a" and x.attributes.get("href"):
                out.append((inner_text(x), self.path(x.attributes["href"], posixpath.dirname(path))))
            stack += [c for c in x.children[::-1] if isinstance(c, Node)]
        return out

    def chapters(self) -> list[tuple[str, int]]:
        """(title, number of its first page): from the table of contents, else the spine, else the navigation page."""
        marks = self.toc() or [("unk", self.resources[i]) for i in self.spine if i not in ("cover", "nav") and i in self.resources] or self.nav()
        number = {p: n for n, p in reversed(list(enumerate(self.pages)))}
        return [(title, number[p]) for title, p in ((t, path.split("#")[0]) for t, path in marks) if p in number]


def read_book(data: bytes) -> Book:
    """Chapters hold the pages from their first on; the page the book opens at (page 0) is never part of one.

    Pages before the first chapter are a chapter by themselves. Lengths stay 0, as pages don't count
    characters, and no images are collected: their hash is that of nothing.
    """
    archive = _Archive(data)
    file_hash = hashlib.sha256(data).hexdigest()
    title = file_hash if archive.title is None else _TITLE.sub("", archive.title)
    marks = archive.chapters()
    if not marks:
        raise NoChapters("no chapter leads to a page")
    chapters: list[Chapter] = []
    page = 0

    def read_to(last: int) -> list[str]:
        nonlocal page
        lines: list[str] = []
        while page < min(last, len(archive.pages) - 1):
            page += 1
            lines += lines_of(archive.text(archive.pages[page]))
        return lines

    if marks[0][1] > 0:
        chapters.append(Chapter("garbage before first chapter", 0, 0, read_to(marks[0][1] - 1)))
    for (name, _), end in zip(marks, [*[n for _, n in marks[1:]], len(archive.pages)]):
        chapters.append(Chapter(name, 0, 0, read_to(end - 1)))
    return Book(title, chapters, file_hash, hashlib.sha256(b"").hexdigest())


def book_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, file_hash, chapter_index, chapter_title, line_index, line) of the EPUB files under a path or pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                book = read_book(data)
                rows = [(name, book.title, book.file_hash, c, chapter.title, n, line) for c, chapter in enumerate(book.chapters) for n, line in enumerate(chapter.lines)]
                kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
                columns = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["path", "title", "file_hash", "chapter_index", "chapter_title", "line_index", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, title string, file_hash string, chapter_index int, chapter_title string, line_index int, line string")


def new_books(books: DataFrame, docs: DataFrame) -> DataFrame:
    """Books whose title isn't among docs yet."""
    return books.join(docs.select("title").distinct(), "title", "left_anti").withColumn("title", F.col("title"))
