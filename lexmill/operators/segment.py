"""Dictionary lookups in running text: prefixes of a text, and forward maximum matching."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.shared import shared


class Trie(dict):
    """Characters to tries; `word` marks the end of a key."""

    word = False

    @classmethod
    def of(cls, keys) -> Trie:
        root = cls()
        for key in keys:
            root.insert(key)
        return root

    def insert(self, key: str) -> None:
        node = self
        for c in key:
            node = node.setdefault(c, Trie())
        node.word = True

    def remove(self, key: str) -> bool:
        """True if the key was there."""
        nodes = [self]
        for c in key:
            if c not in nodes[-1]:
                return False
            nodes.append(nodes[-1][c])
        if not nodes[-1].word:
            return False
        nodes[-1].word = False
        for c, parent, child in zip(key[::-1], nodes[-2::-1], nodes[:0:-1]):
            if child or child.word:
                break
            del parent[c]
        return True

    def has(self, key: str) -> bool:
        node = self
        for c in key:
            if c not in node:
                return False
            node = node[c]
        return node.word

    def steps(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """(start, end, matched): the longest keys from left to right.

        Where the walk from a place breaks off before any key has ended, all characters walked over and
        the one it broke at are passed over; a walk that the end of the text cuts short is a match only
        if it ends on a key.
        """
        start = 0
        while start < len(text):
            node, found, i = self, -1, start
            while i < len(text):
                if node.word:
                    found = i
                if text[i] not in node:
                    break
                node = node[text[i]]
                i += 1
            else:
                yield start, len(text), node.word
                return
            if found > start:
                yield start, found, True
                start = found
            else:
                yield start, i + 1, False
                start = i + 1


def prefixes(texts: DataFrame, keys: DataFrame, text_col: str = "text", key_col: str = "key") -> DataFrame:
    """texts with each key that its text begins with: an equi-join on the text's prefixes, up to the length of the longest key."""
    distinct = keys.select(F.col(key_col).alias("prefix")).where(F.length("prefix") > 0).distinct()
    longest = keys.agg(F.max(F.length(key_col)).alias("_longest"))
    cut = texts.where(F.length(text_col) > 0).join(F.broadcast(longest)).withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.length(text_col), F.greatest("_longest", F.lit(1)))))).withColumn("prefix", F.expr(f"substring(`{text_col}`, 1, _n)"))
    return cut.join(distinct, "prefix").drop("_n", "_longest")


class Matcher:
    """Trie.steps() over texts piece by piece, with a memory of what pieces came to.

    Where no key has a space, every walk ends at the next one: with a match before it, which leaves the space as a step of its own, or past it.
    So what a piece and the space after it come to depends on nothing else. Pieces of `most` characters in all are remembered.
    """

    def __init__(self, trie: Trie, most: int = 8_000_000, cut: int = 200_000):
        self.trie, self.most, self.cut = trie, most, cut
        self.parted = " " not in trie and not any(" " in node for node in _below(trie))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.size = 0
        self.first, self.count, self.length = array("q"), array("q"), array("q")  # by piece
        self.ends, self.matched = array("i"), array("b")  # by step, ends from the piece's start

    def learn(self, pieces: list[str]) -> None:
        for piece in pieces:
            if piece in self.known:
                continue
            self.known[piece] = len(self.first)
            self.first.append(len(self.ends))
            for _, end, matched in self.trie.steps(piece + " "):
                self.ends.append(end)
                self.matched.append(matched)
            self.count.append(len(self.ends) - self.first[-1])
            self.length.append(len(piece) + 1)
            self.size += len(piece) + 40

    def steps(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ends, matched) of the steps, some pieces at a time; each step starts where the one before ends."""
        at = 0
        while self.parted and (to := text.find(" ", min(at + self.cut, len(text) - 1)) if len(text) - at > self.cut else text.rfind(" ", at)) >= 0:
            pieces = text[at:to].split(" ")
            if self.size > self.most:
                self.forget()
            try:
                ids = list(map(self.known.__getitem__, pieces))
            except KeyError:
                self.learn(pieces)
                ids = list(map(self.known.__getitem__, pieces))
            ids = np.array(ids, np.int64)
            n, length = np.frombuffer(self.count, np.int64)[ids], np.frombuffer(self.length, np.int64)[ids]
            where = np.repeat(np.frombuffer(self.first, np.int64)[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield np.frombuffer(self.ends, np.int32)[where] + np.repeat(at + np.cumsum(length) - length, n).astype(np.int32), np.frombuffer(self.matched, np.bool_)[where]
            at = to + 1
        rest = list(self.trie.steps(text[at:]))
        if rest:
            yield np.array([at + end for _, end, _ in rest], np.int32), np.array([m for _, _, m in rest], bool)


def _below(node: Trie) -> Iterator[Trie]:
    nodes = [node]
    while nodes:
        for child in nodes.pop().values():
            yield child
            nodes.append(child)


def maximum_matches(docs: DataFrame, keys: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, step, start, end, matched) of forward maximum matching over whole texts; null counts as empty. keys are a bounded word list.

    A worker holds one text and some 100,000 steps at a time.
    """
    resource = shared(docs.sparkSession, sorted(set(keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Trie.of(resource()))
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            texts = batch.column("t")
            for i, doc in enumerate(batch.column("k").to_pylist()):
                step = start = 0
                for ends, matched in matcher.steps(texts[i].as_py() or ""):
                    n = len(ends)
                    rows.append((doc, np.arange(step, step + n, dtype=np.int32), np.concatenate([[start], ends[:-1]]).astype(np.int32), ends, matched))
                    step, start, held = step + n, int(ends[-1]), held + n
                    if held > 100_000:
                        yield _steps(rows)
                        rows, held = [], 0
        if rows:
            yield _steps(rows)

    return docs.selectExpr(f"cast(`{id_col}` as long) as k", f"`{text_col}` as t").mapInArrow(run, "doc_id long, step int, start int, end int, matched boolean")


def _steps(rows: list[tuple]) -> pa.RecordBatch:
    none = np.array([r[0] is None for r in rows])
    sizes = [len(r[1]) for r in rows]
    ids = pa.array(np.repeat(np.array([r[0] or 0 for r in rows], np.int64), sizes), mask=np.repeat(none, sizes))
    return pa.RecordBatch.from_arrays([ids, *[pa.array(np.concatenate([r[k] for r in rows])) for k in range(1, 5)]], ["doc_id", "step", "start", "end", "matched"])


def word_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """The first field of each line, once, in order."""
    word = F.regexp_extract(column, r"^\s*(\S+)", 1)
    return lines.select(word.alias("word")).where("word <> ''").distinct().orderBy("word")
