"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All pre-tokens of a batch stand in one linked list of symbols; a pre-token's last symbol has no
successor, so no merge crosses it. Each adjacent pair that is a token waits in the bucket of its
merge rank. A two-level bitmap over the ranks gives the lowest non-empty bucket by find-first-set;
stale entries are skipped when they surface. A pre-token of n bytes costs O(n) queue operations,
however long it is; as merges of all pre-tokens share their buckets, most are made by the array.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexmill.llm.arrow_text import slices, worker_cache

_WORD = 256
#: A bucket of so many pairs is merged as an array.
MANY = 96


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Positions by rank; pop_bucket() empties the bucket of the lowest rank that has any."""

    def __init__(self, ranks: int):
        self.words = [0] * (ranks // _WORD + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            k = rank // _WORD
            self.words[k] |= 1 << (rank % _WORD)
            self.top |= 1 << k
        else:
            bucket.append(position)

    def push_all(self, rank: int, positions: list[int]) -> None:
        self.push(rank, positions[0])
        self.buckets[rank].extend(positions[1:])

    def pop_bucket(self) -> tuple[int, list[int]]:
        k = (self.top & -self.top).bit_length() - 1
        word = self.words[k]
        rank = k * _WORD + (word & -word).bit_length() - 1
        word &= word - 1
        self.words[k] = word
        if not word:
            self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Bpe:
    """Encoder and decoder for one table of ranks and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.token = {r: t for t, r in ranks.items()}
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if -1 in self.byte_ids:
            raise ValueError("a byte-level vocabulary has all 256 single bytes")
        self.whole = ranks
        self.size = max(ranks.values()) + 1
        self.shift = self.size.bit_length()
        self.pair: dict[int, int] = {}
        self.byte_pairs = np.full((256, 256), -1, np.int32)
        for t, r in ranks.items():
            if len(t) == 2:
                self.byte_pairs[t[0], t[1]] = r
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    self.pair[a << self.shift | b] = r
        keys = np.fromiter(self.pair, np.int64, len(self.pair))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.fromiter(self.pair.values(), np.int32, len(self.pair))[order], -1)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbols, -1 for none."""
        keys = left.astype(np.int64) << self.shift | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def encode_pretokens(self, pretokens: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token; as the greedy lowest-rank-first, leftmost-first merge gives them.

        rank_at holds the rank of the pair that starts at a position: an entry of the queue is stale
        if it differs. A large bucket is merged at one stroke, unless two of its pairs overlap.
        """
        buf = np.frombuffer(b"".join(pretokens), np.uint8)
        if not len(buf):
            return [[] for _ in pretokens]
        ends = np.cumsum(np.fromiter(map(len, pretokens), np.int64, len(pretokens)))
        n = len(buf)
        last = np.unique(ends[ends > 0]) - 1
        symbol = self.byte_ids[buf]
        nxt = np.arange(1, n + 1, dtype=np.int32)
        nxt[last] = -1
        prev = np.arange(-1, n - 1, dtype=np.int32)
        prev[np.append(0, last[:-1] + 1)] = -1
        rank_at = np.full(n, -1, np.int32)
        rank_at[:-1] = self.byte_pairs[buf[:-1], buf[1:]]
        rank_at[last] = -1
        queue = RankQueue(self.size)
        starts_here = np.zeros(n, bool)
        at = np.flatnonzero(rank_at >= 0)
        at = at[np.argsort(rank_at[at], kind="stable")]
        found, starts = np.unique(rank_at[at], return_index=True)
        listed, bounds = at.tolist(), [*starts.tolist(), len(at)]
        for k, r in enumerate(found.tolist()):
            queue.push_all(r, listed[bounds[k] : bounds[k + 1]])
        push, get, shift = queue.push, self.pair.get, self.shift
        s, x, p, w = memoryview(symbol), memoryview(nxt), memoryview(prev), memoryview(rank_at)
        while queue.top:
            rank, bucket = queue.pop_bucket()
            if len(bucket) >= MANY:
                i = np.array(bucket, np.int32)
                i = i[rank_at[i] == rank]
                i.sort()
                i = i[np.append(True, i[1:] != i[:-1])] if len(i) else i
                j = nxt[i]
                starts_here[i] = True
                overlap = starts_here[j].any()
                starts_here[i] = False
                if not overlap:
                    symbol[i] = rank
                    symbol[j] = -1
                    rank_at[j] = -1
                    k = nxt[j]
                    nxt[i] = k
                    has = k >= 0
                    prev[k[has]] = i[has]
                    rank_at[i] = -1
                    h = prev[i]
                    for left in (i[has], h[h >= 0]):
                        new = self.ranks_of(symbol[left], symbol[nxt[left]])
                        rank_at[left] = new
                        order = np.argsort(new, kind="stable")
                        order = order[np.searchsorted(new[order], 0) :]
                        if not len(order):
                            continue
                        new = new[order]
                        starts = np.flatnonzero(np.append(True, new[1:] != new[:-1]))
                        listed, bounds = left[order].tolist(), [*starts.tolist(), len(order)]
                        for m, r in enumerate(new[starts].tolist()):
                            queue.push_all(r, listed[bounds[m] : bounds[m + 1]])
                    continue
            bucket.sort()  # leftmost first
            for i in bucket:
                if w[i] != rank:
                    continue  # stale: merged away, or a neighbour changed
                j = x[i]
                s[i] = rank
                s[j] = w[j] = -1
                k = x[i] = x[j]
                if k >= 0:
                    p[k] = i
                    r = get(rank << shift | s[k], -1)
                    w[i] = r
                    if r >= 0:
                        push(r, i)
                else:
                    w[i] = -1
                h = p[i]
                if h >= 0:
                    r = get(s[h] << shift | rank, -1)
                    w[h] = r
                    if r >= 0:
                        push(r, h)
        alive = symbol >= 0
        ids = symbol[alive].tolist()
        cuts = np.append(0, np.cumsum(alive))[ends].tolist()
        return [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]

    def pretokens(self, text: str) -> list[bytes]:
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()) and text[0] != "'":
            return [text.encode()]
        return [x.encode() for x in self.pattern.findall(text)]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text by itself: all their distinct pre-tokens go through one rank queue; those that are tokens need none."""
        parts = [self.pretokens(t) if t else [] for t in texts]
        known: dict[bytes, list[int]] = {}
        left: dict[bytes, None] = {}
        for p in parts:
            for x in p:
                if x not in known and x not in left:
                    whole = self.whole.get(x)
                    if whole is None:
                        left[x] = None
                    else:
                        known[x] = [whole]
        known |= zip(left, self.encode_pretokens(list(left)))
        return [known[p[0]] if len(p) == 1 else [i for x in p for i in known[x]] for p in parts]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Pieces(dict):
    """Ids (decimal, comma-joined) of pieces of text; ``bytes_of`` has what those ids decode to.

    A piece is what str.split(" ") gives, and stands for itself after a space; a text's first piece has two
    spaces before its key. Unless a piece is blank, no match of the pattern begins before it and ends in
    it. Pieces are held in two generations: what isn't met for a whole generation is forgotten.
    """

    def __init__(self, bpe: Bpe, most: int = 300_000):
        self.bpe, self.most = bpe, most
        self.decimal = list(map(str, range(bpe.size)))
        self.bytes_of: dict[str, bytes] = {}
        self.old: tuple[dict[str, str], dict[str, bytes]] = ({}, {})

    def text_of(self, found: list[int]) -> tuple[str, bytes]:
        if len(found) == 1:
            return self.decimal[found[0]], self.bpe.token[found[0]]
        return ",".join([self.decimal[i] for i in found]), self.bpe.decode_bytes(found)

    def turn(self) -> None:
        """Called between batches."""
        if len(self) > self.most:
            self.old = (dict(self), self.bytes_of)
            self.clear()
            self.bytes_of = {}

    def learn(self, keys: set[str]) -> None:
        """Takes the pieces that aren't known yet, none blank, through the rank queue together."""
        old, old_bytes = self.old
        new = []
        for k in keys:
            if k in old:
                self[k], self.bytes_of[k] = old[k], old_bytes[k]
            else:
                new.append(k)
        found = self.bpe.encode_all([k[2:] if k[:2] == "  " else " " + k for k in new])
        for k, ids in zip(new, found):
            self[k], self.bytes_of[k] = self.text_of(ids)

    def encoded(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids, comma-joined, and the bytes they decode to."""
        self.turn()
        split = []
        for t in texts:
            parts = t.split(" ")
            parts[0] = "  " + parts[0]
            split.append(parts)
        missing = {p for p in set().union(*split) if p not in self}
        blank = {p for p in missing if not p or p.isspace()}
        self.learn(missing - blank)
        odd = [i for i, parts in enumerate(split) if not blank.isdisjoint(parts)] if blank else []
        whole = dict(zip(odd, self.bpe.encode_all([texts[i] for i in odd])))  # two spaces in a row, or one at an end
        for i, parts in enumerate(split):
            if i in whole:
                yield self.text_of(whole[i])
            else:
                yield ",".join(map(self.__getitem__, parts)), b"".join(map(self.bytes_of.__getitem__, parts))


DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: n_tokens, SHA-256 of the ids (decimal, comma-joined) and of the decoded bytes.

    with_ids adds ids_text, the ids themselves. Runs inside the scan, without a shuffle; a worker holds
    a bounded cache of encoded pieces. Null text counts as empty (0 tokens); a null id stays null; repeated
    rows give repeated results; other columns of docs are ignored; an empty table gives an empty result.
    Every worker reads ranks_path, a file of the installed tokenizers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("bpe")
        key = ("bpe", ranks_path, pattern)
        if key not in cache:
            cache[key] = Pieces(Bpe(read_ranks(ranks_path), pattern))
        known: Pieces = cache[key]
        sha = hashlib.sha256
        for batch in slices(batches, "t", 1 << 21):
            n, ids_sha, dec_sha, texts = [], [], [], []
            for ids, data in known.encoded([t or "" for t in batch.column("t").to_pylist()]):
                ids_sha.append(sha(ids.encode()).hexdigest())
                dec_sha.append(sha(data).hexdigest())
                n.append(ids.count(",") + 1 if ids else 0)
                if with_ids:
                    texts.append(ids)
            columns = [batch.column("k"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(dec_sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(texts, pa.string()))
                names.append("ids_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as k", f"`{text_col}` as t")
    return rows.mapInArrow(run, DIGEST_SCHEMA + (", ids_text string" if with_ids else ""))


def decode_ids(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids_text") -> DataFrame:
    """The texts back from comma-joined ids; bytes that are no UTF-8 are replaced. Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("bpe")
        key = ("decode", ranks_path)
        if key not in cache:
            cache[key] = {str(r).encode(): t for t, r in read_ranks(ranks_path).items()}
        of = cache[key].__getitem__
        for batch in batches:
            texts = [None if x is None else b"".join(map(of, x.encode().split(b","))).decode("utf-8", "replace") if x else "" for x in batch.column("i").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.selectExpr(f"cast(`{id_col}` as long) as k", f"`{ids_col}` as i").mapInArrow(run, "doc_id long, text string")
