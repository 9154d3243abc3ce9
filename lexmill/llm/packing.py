"""Packing of tokenised documents into training sequences of bounded cost spread."""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lexmill.llm.arrow_text import slices, worker_cache

#: From so many white-space characters in a row on, tiktoken's pattern matcher gives up.
_BLANK_RUN = re.compile(r"\s{10000}")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def as_tiktoken(path: str):
    """The tokenizer file as a tiktoken encoding, or None if it isn't plain byte-level BPE whose ids ascend with its merges.

    For such a file the order of merges and the order of ids say the same, so that both libraries give the same ids.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True) and file["normalizer"] is None
    if not plain or any(not t.get("special") for t in file["added_tokens"]):
        return None
    vocab, byte = model["vocab"], byte_alphabet()
    merged = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    singles = [vocab.get(c) for c in byte]
    if None in singles or None in merged or merged != sorted(merged) or len(set(merged)) != len(merged) or max(singles) > min(merged, default=1 << 31) or len(merged) + 256 != len(vocab):
        return None
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items()}
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class TextIds:
    """The ids of whole texts by a tokenizer file, as little-endian 32-bit numbers; special tokens in a text are ordinary text.

    Byte-level BPE runs in tiktoken, several times as fast; all else, and texts with endless blanks, in tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.fast = as_tiktoken(path)

    def ids(self, text: str) -> bytes:
        if self.fast is None or len(text) >= 10_000 and _BLANK_RUN.search(text):
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        out = array("I", found)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()


def assign(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """Pieces (item, start, length, sequence) of items of up to size tokens.

    Longest first, each goes to the sequence of least cost (linear * n + quadratic * n * n over its
    pieces) among those with room for it; where none has room, it is cut to fit the one with most room.
    So few sequences are opened that fewer than size tokens of room are left in all of them together.
    """
    total = int(lengths.sum())
    if not total:
        return []
    room = np.full(-(-total // size), size, np.int64)
    cost = np.zeros(len(room))
    out = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        left, start = int(lengths[item]), 0
        while left:
            fits = np.where(room >= left, cost, np.inf)
            k = int(fits.argmin())
            if fits[k] == np.inf:
                k = int(room.argmax())
            n = min(left, int(room[k]))
            out.append((item, start, n, k))
            room[k] -= n
            cost[k] += linear * n + quadratic * n * n
            start += n
            left -= n
    return out


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1.0 / 4096,
         chunk_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most size tokens; each token lies in exactly one piece.

    A document's tokens are the tokenizer's and end_id. Whole sequences are cut off a long document; what
    remains of all documents of a chunk (about chunk_tokens tokens of one input partition) is assigned
    by cost. A chunk leaves less than one sequence of padding, and no row is shuffled. sequence_id is
    unique: the partition's number, then a count. with_ids adds the piece's ids as an array.

    Null text counts as empty (only end_id); a null id stays null; repeated rows are packed each; other
    columns of docs are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("packing")
        key = ("pack", tokenizer_path)
        if key not in cache:
            cache[key] = TextIds(tokenizer_path)
        known: TextIds = cache[key]
        end = np.array([end_id], "<u4").tobytes()
        next_sequence = TaskContext.get().partitionId() << 33
        keys: list = []
        encoded: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal next_sequence
            lengths = np.array([len(x) // 4 for x in encoded], np.int64)
            whole = lengths // size
            placed = []
            for item in np.flatnonzero(whole).tolist():
                for k in range(int(whole[item])):
                    placed.append((item, k * size, size, next_sequence, 0))
                    next_sequence += 1
            filled: dict[int, int] = {}
            for item, start, n, k in assign(lengths % size, size, linear, quadratic):
                at = filled.get(k, 0)
                placed.append((item, int(whole[item]) * size + start, n, next_sequence + k, at))
                filled[k] = at + n
            next_sequence += len(filled)
            item, start, n, sequence, offset = (list(x) for x in zip(*placed))
            crc = [zlib.crc32(encoded[i][4 * s : 4 * (s + m)]) for i, s, m in zip(item, start, n)]
            long = lambda x: pa.array(x, pa.int64())
            columns = [long([keys[i] for i in item]), long(start), long(n), long(crc), long(lengths[item]), long(sequence), long(offset)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(encoded[i][4 * s : 4 * (s + m)], "<u4").astype(np.int32) for i, s, m in zip(item, start, n)], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        held = 0
        for batch in slices(batches, "t", 1 << 21):
            for k, text in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist()):
                ids = known.ids(text or "") + end
                keys.append(k)
                encoded.append(ids)
                held += len(ids) // 4
                if held >= chunk_tokens:
                    yield flush()
                    keys.clear()
                    encoded.clear()
                    held = 0
        if keys:
            yield flush()

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as k", f"`{text_col}` as t")
    return rows.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
