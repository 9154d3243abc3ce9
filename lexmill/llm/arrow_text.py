"""Whole texts as numpy arrays: word bounds and 64-bit word hashes without a Python loop.

A word is a maximal run of bytes that a 256-entry table does not map to 0. Its hash is the XXH64 of the
bytes that the table maps it to.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lexmill.llm.xxh64 import xxh64

SEGMENT = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"


def worker_cache(owner: str = "") -> dict:
    """A dictionary that lives as long as the Python worker serves one operator, for tables that are dear to build.

    Spark keeps workers from job to job: what another operator has left is dropped.
    """
    held = sys.modules.setdefault("_lexmill_worker_cache", types.ModuleType("_lexmill_worker_cache")).__dict__
    if held.get("owner") != owner:
        for other in [k for k, v in held.items() if isinstance(v, dict)]:
            del held[other]
        held["owner"] = owner
    return held.setdefault(f"of {owner}", {})


def plain_table() -> np.ndarray:
    """Words `[^\\x20\\x09-\\x0D]+`, bytes unchanged (0 separates; byte 0 itself stands as 256)."""
    t = np.arange(256, dtype=np.uint16)
    t[0] = 256
    t[list(SPACES)] = 0
    return t


def lower_table() -> np.ndarray:
    """As plain_table, with A-Z in lower case."""
    t = plain_table()
    t[65:91] = np.arange(97, 123)
    return t


def letter_table() -> np.ndarray:
    """Words of ASCII letters in lower case and of all bytes from 0x80."""
    t = np.zeros(256, np.uint16)
    t[97:123] = t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def chained(hashes: np.ndarray, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hash of hashes[i : i + length] for each i of at: each step mixes what is there with the next, so that no sum of differences cancels."""
    length = np.broadcast_to(np.asarray(length, np.int64), at.shape)
    h = length.astype(np.uint64)
    for k in range(int(length.max(initial=0))):
        on = length > k
        if on.all():
            h = mix(h * _STEP + hashes[at + k])
        else:
            h[on] = mix(h[on] * _STEP + hashes[at[on] + k])
    return h


def words(buf: np.ndarray, doc_starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (byte offsets in buf) and hashes of all words; words never cross doc_starts."""
    out_s, out_e, out_h = [], [], []
    n, at = len(buf), 0
    written_as = table.astype(np.uint8)
    cuts = np.unique(np.append(doc_starts, n))
    while at < n:
        end = min(n, at + SEGMENT)
        if end < n:  # a segment ends where a document starts or at a separator
            k = np.searchsorted(cuts, end, side="right") - 1
            cut = int(cuts[k]) if k >= 0 and cuts[k] > at else -1
            sep = np.flatnonzero(table[buf[max(at, end - 65536) : end]] == 0)
            if len(sep):
                cut = max(cut, max(at, end - 65536) + int(sep[-1]))
            if cut <= at:
                later = int(cuts[np.searchsorted(cuts, end, side="left")])
                sep = np.flatnonzero(table[buf[end:later]] == 0)
                cut = end + int(sep[0]) if len(sep) else later
            end = cut
        inside = table[buf[at:end]] != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        here = cuts[np.searchsorted(cuts, at, side="right") : np.searchsorted(cuts, end, side="left")] - at
        first[here] = inside[here]
        last[here - 1] = inside[here - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        out_h.append(xxh64(written_as[buf[at:end]], s, e, 0))
        out_s.append(s + at)
        out_e.append(e + at)
        at = end
    if not out_s:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_s), np.concatenate(out_e), np.concatenate(out_h)


def text_buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, joined, and the n + 1 offsets; null is the empty text."""
    text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice holds most_bytes of text or is one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
