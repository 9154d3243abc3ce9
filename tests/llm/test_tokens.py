"""Byte-level BPE against tiktoken, and packing against tokenizers."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexmill.llm import bpe, packing

PATH = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(bpe.read_ranks(PATH), P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab 's\n.,'é😀漢1", max_size=60), st.text("abc", min_size=40, max_size=400)))
def test_encodes_as_tiktoken(own, reference, text):
    pieces = own.pattern.findall(text)
    want = reference.encode_ordinary(text)
    assert [i for ids in own.encode_pretokens([p.encode() for p in pieces]) for i in ids] == want  # all by the queue
    assert own.encode(text) == want
    ids, data = next(bpe.Pieces(own).encoded([text]))
    assert ids == ",".join(map(str, want)) and data == text.encode()


def test_very_long_pretokens(own, reference):
    for text in ("a" * 20_000, "abcab" * 5_000, "漢字" * 3_000):
        assert own.encode(text) == reference.encode_ordinary(text)


def test_pieces_turn_over(own, reference):
    known = bpe.Pieces(own, most=3)
    texts = ["one two  three", "", "one two", "four five six seven", "two\n\nthree", "one"]
    for some in ([t] for t in texts * 2):
        assert [i for i, _ in known.encoded(some)] == [",".join(map(str, reference.encode_ordinary(t))) for t in some]
    assert [d for _, d in known.encoded(texts)] == [t.encode() for t in texts]


def test_tables_go_through_the_queue(own, reference, monkeypatch):
    """Every pre-token of the test table that isn't a token itself is encoded by the rank queue."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()[:200]
    sent = set()
    encode = own.encode_pretokens
    monkeypatch.setattr(own, "encode_pretokens", lambda p: (sent.update(p), encode(p))[1])
    known = bpe.Pieces(own)
    for at in range(0, len(texts), 50):
        for (ids, _), t in zip(known.encoded(texts[at : at + 50]), texts[at : at + 50]):
            assert ids == ",".join(map(str, reference.encode_ordinary(t)))
    want = {x.encode() for t in texts for x in own.pattern.findall(t)}
    assert sent >= {x for x in want if x not in own.whole} and len(sent) > 5000


def test_rank_queue():
    q = bpe.RankQueue(1000)
    for rank, at in ((900, 1), (3, 2), (3, 5), (256, 7)):
        q.push(rank, at)
    assert [q.pop_bucket() for _ in range(3)] == [(3, [2, 5]), (256, [7]), (900, [1])] and not q.top


def test_table(spark, docs, none, texts, reference):
    out = bpe.encode_documents(docs, PATH, P.PATTERN, with_ids=True)
    rows = out.collect()
    assert len(rows) == len(texts)
    known = {}
    for k, t in texts:
        ids = ",".join(map(str, reference.encode_ordinary(t or "")))
        known.setdefault(k, set()).add((hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), len(ids.split(",")) if ids else 0))
    assert all((r.ids_sha256, r.decoded_sha256, r.n_tokens) in known[r.doc_id] for r in rows)
    back = sorted((r.doc_id or -1, r.text) for r in bpe.decode_ids(out, PATH).collect())
    assert back == sorted((k or -1 if k is not None else -1, t or "") for k, t in texts)
    assert bpe.encode_documents(none, PATH, P.PATTERN).count() == 0


def test_packing(spark, docs, none, texts):
    tk = Tokenizer.from_file(JSON)
    tk.encode_special_tokens = True
    size = 64
    rows = packing.pack(docs.where("doc_id <> 7"), JSON, size=size, with_ids=True).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    total = 0
    for k, t in texts:
        if k is None or k == 7:
            continue
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            part = ids[at : at + r.length]
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.ids == part.tolist()
            at += r.length
        assert at == len(ids)
    filled: dict = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    partitions = docs.rdd.getNumPartitions()
    assert len(filled) <= -(-total // size) + partitions
    assert packing.pack(none, JSON).count() == 0
    assert sum(r.length for r in packing.pack(docs.where("doc_id = 7"), JSON).collect()) == 3 * by_doc_tokens(tk, texts, 7)


def by_doc_tokens(tk, texts, k):
    return len(tk.encode(next(t for i, t in texts if i == k), add_special_tokens=False).ids) + 1


@given(st.lists(st.integers(0, 63), max_size=40))
def test_assignment_leaves_less_than_a_sequence(lengths):
    placed = packing.assign(np.array(lengths, np.int64), 64, 1.0, 1 / 64)
    used: dict = {}
    for item, start, n, k in placed:
        used[k] = used.get(k, 0) + n
    assert sum(used.values()) == sum(lengths) and all(v <= 64 for v in used.values())
    assert len(used) <= -(-sum(lengths) // 64)


def test_assignment_balances_cost():
    placed = packing.assign(np.array([60, 30, 30, 4, 4]), 64, 1.0, 1 / 64)
    assert [k for _, _, _, k in placed] == [0, 1, 1, 1, 0] or len({k for *_, k in placed}) == 2
    # brute force: each piece goes to the cheapest sequence that has room, longest first
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 33, 200)
    room, cost = [64] * -(-int(lengths.sum()) // 64), [0.0] * -(-int(lengths.sum()) // 64)
    for item, start, n, k in packing.assign(lengths, 64, 1.0, 1 / 64):
        left = int(lengths[item]) - start
        fits = [i for i, r in enumerate(room) if r >= left]
        if fits:
            assert n == left and cost[k] == min(cost[i] for i in fits)
        else:
            assert room[k] == max(room) == n
        room[k] -= n
        cost[k] += n + n * n / 64


@pytest.fixture(scope="module")
def whole():
    return packing.TextIds(JSON)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab 's\n\t.,'é😀漢1<|>", max_size=80)))
def test_ids_are_those_of_tokenizers(whole, text):
    assert whole.fast is not None
    assert np.frombuffer(whole.ids(text), "<u4").tolist() == whole.tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_odd_texts(whole):
    for text in ("<|endoftext|>", "x" * 30_000, " \n" * 6_000 + "end", "a" + "\u3000" * 12_000, "word " * 20_000):
        assert np.frombuffer(whole.ids(text), "<u4").tolist() == whole.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(whole.ids(" " * 1_000_000)) > 0
    assert packing.as_tiktoken(P.path("word_bpe_49k.json")) is None
    other = packing.TextIds(P.path("word_bpe_49k.json"))
    assert np.frombuffer(other.ids("Some words"), "<u4").tolist() == other.tokenizer.encode("Some words", add_special_tokens=False).ids


def test_packing_of_null_ids(spark, docs, texts):
    rows = packing.pack(docs.where("doc_id is null"), JSON).collect()
    want = sorted(len(Tokenizer.from_file(JSON).encode(t or "", add_special_tokens=False).ids) + 1 for k, t in texts if k is None)
    assert all(r.doc_id is None for r in rows) and sorted(r.doc_tokens for r in rows if r.start == 0) == want
