"""Features of whole texts, and bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.arrow_text import letter_table, text_buffers, words

#: Classes of bytes whose shares describe a text's structure.
_CLASSES = ["lower", "upper", "digit", "space", "line", "stop", "comma", "mark", "bar", "bracket", "high", "other"]


def _class_table() -> np.ndarray:
    t = np.full(256, _CLASSES.index("other"), np.uint8)
    for name, chars in {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\x0b\x0c\r", "line": b"\n", "stop": b".?:;", "comma": b",'\"-", "mark": b"!#$%&*@^~+=`\\/_", "bar": b"|", "bracket": b"<>{}[]()"}.items():
        t[list(chars)] = _CLASSES.index(name)
    t[128:] = _CLASSES.index("high")
    return t


def fold(column: str = "doc_id") -> F.Column:
    """crc32 of the id as text; of the empty text for null."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def word_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of each distinct word (ASCII letters in lower case and bytes from 0x80).

    Also how many words of each text repeat the word before them.
    """
    buf, offsets = text_buffers(text)
    starts, _, h = words(buf, offsets[:-1], letter_table())
    doc = np.searchsorted(offsets, starts, side="right") - 1
    echoes = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=len(text))
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h))), echoes


STRUCTURE = [*(f"share_{c}" for c in _CLASSES), "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "repeated_lines", "words_a_line", "stops_a_word", "echoes"]


def structure(text: pa.Array, doc: np.ndarray, count: np.ndarray, echoes: np.ndarray) -> np.ndarray:
    """A row of STRUCTURE for each text; doc, count and echoes are as word_sets gives them."""
    buf, offsets = text_buffers(text)
    n = len(text)
    sizes = np.diff(offsets)
    classes = np.bincount(np.repeat(np.arange(n) * len(_CLASSES), sizes) + _class_table()[buf], minlength=n * len(_CLASSES)).reshape(n, -1)
    n_words = np.bincount(doc, count, n)
    distinct = np.bincount(doc, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, doc, count)
    lines = np.ones(256, np.uint16)
    lines[:] = np.arange(256)
    lines[0], lines[10] = 256, 0
    at, _, h = words(buf, offsets[:-1], lines)
    line_doc = np.searchsorted(offsets, at, side="right") - 1
    order = np.lexsort((h, line_doc))
    d, h = line_doc[order], h[order]
    again = np.bincount(d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])], minlength=n) if len(h) else np.zeros(n)
    n_lines = np.bincount(line_doc, minlength=n)
    some = np.maximum(n_words, 1)
    letters = classes[:, 0] + classes[:, 1] + classes[:, _CLASSES.index("high")]
    return np.column_stack([
        classes / np.maximum(sizes, 1)[:, None], np.log1p(sizes), np.log1p(n_words), letters / some, distinct / np.sqrt(some), top / some,
        again / np.maximum(n_lines, 1), np.log1p(n_words / np.maximum(n_lines, 1)), classes[:, _CLASSES.index("stop")] / some, echoes / some,
    ])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: F.Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, t, y) of at most `most` labelled documents: those whose hashed id is least, a bounded documented sample.

    keep is a condition on column k, the id. Rows without label are passed over; of several labels of a
    document the greatest counts.
    """
    of = labels.select(F.col("doc_id").cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("y is not null and k is not null")
    chosen = of.where(keep).groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(most)
    rows = docs.selectExpr(f"cast(`{id_col}` as long) as k", f"coalesce(`{text_col}`, '') as t")
    return rows.join(F.broadcast(chosen), "k")  # at most `most` pairs of numbers
