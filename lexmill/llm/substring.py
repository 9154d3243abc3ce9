"""Substring deduplication with difference-cover anchors.

Two equal windows of `window` words start at any two positions i and j. A difference cover D modulo p
has for every i and j a shift d < p with both (i + d) mod p and (j + d) mod p in D; so both windows hold
an equal anchor of window - p + 1 words that starts at a cover position. Only anchors are compared over
the whole corpus; windows around anchors seen twice are then extended to their full length and compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm.arrow_text import chained, plain_table, text_buffers, words
from lexmill.llm.exchange import aligned, answered, as_batches, gathered, groups, questions, tasks_for, together
from lexmill.llm.storage import written
from lexmill.llm.xxh64 import xxh64

PERIOD = 13
#: A perfect difference cover modulo 13: each residue is a difference of two of them.
COVER = (0, 1, 3, 9)
_FIRST = np.iinfo(np.int64).min


class Batch:
    """The words of a batch's texts; anchors and windows by the word they start at."""

    def __init__(self, docs: pa.RecordBatch, window: int):
        self.docs, self.window = docs, window
        self.buf, offsets = text_buffers(docs.column("t"))
        self.offsets = offsets
        self.starts, self.ends, self.hashes = words(self.buf, offsets[:-1], plain_table())
        doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.counts = np.bincount(doc, minlength=docs.num_rows)
        self.first = np.cumsum(self.counts) - self.counts
        self.doc = doc
        self.position = np.arange(len(doc)) - self.first[doc]
        self.left = self.counts[doc] - self.position
        ids = docs.column("k")
        self.ids = ids.fill_null(_FIRST).to_numpy(zero_copy_only=False) if ids.null_count else ids.to_numpy()

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start words, sorted distinct hashes, and which of those each start has."""
        length = self.window - PERIOD + 1
        at = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[self.position % PERIOD] & (self.left >= length))
        keys, which = np.unique(chained(self.hashes, at, length), return_inverse=True)
        return at, keys, which

    def windows(self, seen: np.ndarray) -> Windows:
        """The windows that hold an anchor that is seen in another batch or twice in this one."""
        at, keys, which = self.anchors()
        twice = seen.astype(bool) | (np.bincount(which, minlength=len(keys)) > 1)
        hit = np.zeros(len(self.doc) + 1, np.int32)
        hit[1:][at[twice[which]]] = 1
        before = np.cumsum(hit)
        j = np.flatnonzero(self.left >= self.window)
        return Windows(self, j[before[j + PERIOD] > before[j]])


class Windows:
    """Windows of a batch, sorted by their words; `least` of equal ones starts first."""

    def __init__(self, batch: Batch, at: np.ndarray):
        cover = np.zeros(len(batch.doc) + 1, np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + batch.window, -1)
        used = np.flatnonzero(np.cumsum(cover[:-1]))
        other = np.zeros(len(batch.doc), np.uint64)  # a second hash of the words' bytes, independent of the first
        other[used] = xxh64(batch.buf, batch.starts[used], batch.ends[used], 1)
        a = chained(batch.hashes, at, batch.window)
        b = (chained(other, at, batch.window) >> np.uint64(32)).astype(np.uint32)
        ids, position = batch.ids[batch.doc[at]], batch.position[at]
        order, new = groups(a, b)
        order = np.lexsort((position, ids, b, a))
        self.at, self.a, self.b, self.ids, self.position = at[order], a[order], b[order], ids[order], position[order].astype(np.uint32)
        self.least = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1

    def repeated(self, earlier: np.ndarray) -> np.ndarray:
        """Start words of the windows that also start earlier, here or (earlier, by group) elsewhere."""
        if not len(self.at):
            return self.at
        i = self.least[self.group]
        return self.at[earlier.astype(bool)[self.group] | (self.ids > self.ids[i]) | (self.ids == self.ids[i]) & (self.position > self.position[i])]


def _seen_elsewhere(keys: np.ndarray, values: list, part: np.ndarray):
    order, new = groups(keys)
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    out = np.zeros(len(keys), np.uint8)
    out[order] = np.repeat(size > 1, size)
    return out, None


def _starts_earlier(a: np.ndarray, values: list, part: np.ndarray):
    b, ids, position = values
    order = np.lexsort((position, ids, b, a))
    _, new = groups(a, b)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    i, p = ids[order], position[order]
    out = np.zeros(len(a), np.uint8)
    out[order] = (i > i[first]) | (i == i[first]) & (p > p[first])
    return out, None


def kept(batch: Batch, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of each document's kept words, joined by one space: all of them, and n + 1 offsets."""
    k = np.flatnonzero(~removed)
    doc = batch.doc[k]
    inner = np.zeros(len(k), bool)  # another kept word of the document follows
    inner[:-1] = doc[:-1] == doc[1:]
    mask = np.zeros(len(batch.buf) + 1, np.int8)
    np.add.at(mask, batch.starts[k], 1)
    np.add.at(mask, batch.ends[k], -1)
    mask = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
    out = batch.buf.copy()
    gap = batch.ends[k][inner]  # a separator stands here, as a word of the same document follows
    out[gap] = 32
    mask[gap] = True
    size = np.bincount(doc, batch.ends[k] - batch.starts[k] + inner, len(batch.counts)).astype(np.int64)
    return out[mask], np.append(0, np.cumsum(size))


def remaining(batch: Batch, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each document without the removed words and the white space behind them, and n + 1 offsets."""
    nxt = np.append(batch.starts[1:], len(batch.buf))
    last = batch.left == 1
    nxt[last] = batch.ends[last]
    mask = np.zeros(len(batch.buf) + 1, np.int8)
    np.add.at(mask, batch.starts[removed], 1)
    np.add.at(mask, nxt[removed], -1)
    stay = np.cumsum(mask[:-1], dtype=np.int8) == 0
    at = np.append(0, np.cumsum(stay))
    return batch.buf[stay], at[batch.offsets]


DIGEST_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: list[str] | None = None, batch_bytes: int = 2 << 20) -> DataFrame:
    """Per row of docs: n_words, n_removed, and the SHA-256 of the kept words joined by one space.

    A word goes if a window of `window` words over it has the same words as one that starts earlier, that
    is, in a document of smaller id or earlier in the same document. with_text adds kept_text, the text
    without the removed words and the white space behind each; columns named in carry come along. Words
    are `[^\\x20\\x09-\\x0D]+`, compared as bytes by 96 bits of hash, from two independent XXH64 of each word.

    Null text counts as empty. Rows of null id count as one document that comes before all others, and
    rows that repeat an id as the same document: of such rows with equal words at equal places neither
    is the earlier. Repeated rows give repeated results; an empty table gives an empty result.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window has at least {PERIOD + 1} words")
    carry = carry or []
    columns = {"k": f"cast(`{id_col}` as long)", "t": f"`{text_col}`"} | {f"c{i}": f"`{c}`" for i, c in enumerate(carry)}
    batches = written(as_batches(docs, columns, batch_bytes), "substring-batches")
    tasks = tasks_for(docs)
    buckets = 4 * tasks

    def ask_anchors(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, part, _ in gathered(rows):
            yield questions(b, buckets, Batch(part, window).anchors()[1])

    def ask_windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, part, answers in gathered(rows):
            w = Batch(part, window).windows(aligned(answers, 1, np.uint8))
            i = w.least
            yield questions(b, buckets, w.a[i], w.b[i], w.ids[i], w.position[i])

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, answers in gathered(rows):
            batch = Batch(part, window)
            at = batch.windows(aligned(answers, 1, np.uint8)).repeated(aligned(answers, 2, np.uint8))
            cover = np.zeros(len(batch.doc) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            removed = np.cumsum(cover[:-1]) > 0
            data, offsets = kept(batch, removed)
            whole, bounds = memoryview(data), offsets.tolist()
            sha = [hashlib.sha256(whole[x:y]).hexdigest() for x, y in zip(bounds, bounds[1:])]
            gone = np.bincount(batch.doc[removed], minlength=part.num_rows)
            out = [part.column("k"), pa.array(batch.counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                data, offsets = remaining(batch, removed)
                out.append(pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays([*out, *[part.column(f"c{i}") for i in range(len(carry))]], [*names, *[f"c{i}" for i in range(len(carry))]])

    anchors = written(answered(batches.mapInArrow(ask_anchors, batches.schema), [], _seen_elsewhere, 1, tasks), "substring-anchors")
    windows = together(batches, anchors).mapInArrow(ask_windows, batches.schema)
    repeats = written(answered(windows, [np.uint32, np.int64, np.uint32], _starts_earlier, 2, tasks), "substring-windows")
    more = (", kept_text string" if with_text else "") + "".join(f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    return together(batches, anchors, repeats).mapInArrow(finish, DIGEST_SCHEMA + more).withColumnsRenamed({f"c{i}": c for i, c in enumerate(carry)})
