"""Exact BM25 top-k: an inverted index per shard with block-max bounds, merged by global statistics.

Document frequencies, the number of documents and their mean length are those of the whole corpus, so the
scores of all shards compare. Within a shard a query's terms part into essential ones, rare in the
shard, whose postings are added up in full, and frequent ones, of which each block of 64 documents has
the greatest impact. A block is looked into only if its greatest frequent part and its best rare part
together can beat the k-th best score that a query has so far, in this and earlier shards of the task: the
pivot test of block-max WAND, for many queries and all blocks of a shard at once. Documents of a shard, and queries
of a block, are alike in their frequent words (say, of one language), so that queries pass over most shards of others.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.arrow_text import lower_table, slices, text_buffers, words
from lexmill.llm.exchange import aligned, answered, as_batches, figure_sums, figures_of, gathered, groups, questions, tasks_for, together
from lexmill.llm.storage import written

K1, B = 1.2, 0.75
BLOCK = 64
#: A term in over this share of a shard's documents counts as frequent there.
FREQUENT = 0.06
#: Documents of a batch are parted into so many kinds at most, of so many documents at least.
KINDS, LEAST_OF_KIND = 8, 128
_MARGIN = 1e-9
SCHEMA = "query_id long, doc_id long, score double"


class Batch:
    """Words of a batch's texts: distinct ones (keys), and postings by key, then document."""

    def __init__(self, docs: pa.RecordBatch):
        buf, offsets = text_buffers(docs.column("t"))
        starts, _, h = words(buf, offsets[:-1], lower_table())
        doc = np.searchsorted(offsets, starts, side="right") - 1
        self.ids = docs.column("k").to_numpy()
        self.lengths = np.bincount(doc, minlength=docs.num_rows)
        self.keys, which = np.unique(h, return_inverse=True)
        pair, self.tf = np.unique(which * np.int64(max(1, docs.num_rows)) + doc, return_counts=True)
        self.term, self.doc = pair // max(1, docs.num_rows), pair % max(1, docs.num_rows)
        self.df = np.bincount(self.term, minlength=len(self.keys))


def _packed(**arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unpacked(data) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _merged(blocks: list[dict]) -> pa.RecordBatch:
    lengths = np.concatenate([np.diff(b["bounds"]) for b in blocks])
    terms, which = np.unique(np.concatenate([b["terms"] for b in blocks]), return_inverse=True)
    data = _packed(query_ids=np.concatenate([b["ids"] for b in blocks]), bounds=np.append(0, np.cumsum(lengths)), terms=terms, which=which.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])


def kinds(batch: Batch, k: int = KINDS, rounds: int = 6) -> np.ndarray:
    """A number below k for each document, by spherical k-means on the words in over FREQUENT of the documents; what isn't worth a kind of its own joins another."""
    n = len(batch.ids)
    frequent = np.flatnonzero(batch.df > max(FREQUENT * n, 8))
    if n < 2 * LEAST_OF_KIND or not len(frequent):
        return np.zeros(n, np.int64)
    frequent = frequent[np.argsort(-batch.df[frequent], kind="stable")[:512]]
    number = np.full(len(batch.keys), -1)
    number[frequent] = np.arange(len(frequent))
    on = number[batch.term] >= 0
    x = np.zeros((n, len(frequent)), np.float32)
    x[batch.doc[on], number[batch.term[on]]] = 1
    x *= np.log(n / batch.df[frequent]).astype(np.float32)
    x /= np.sqrt((x**2).sum(1, keepdims=True)) + 1e-9
    centre = x[np.linspace(0, n - 1, k).astype(np.int64)]
    for i in range(rounds):
        kind = np.argmax(x @ centre.T, 1)
        large = np.bincount(kind, minlength=len(centre)) >= (LEAST_OF_KIND if i > rounds // 2 else 1)
        if not large.any():
            return np.zeros(n, np.int64)
        centre = np.stack([x[kind == c].sum(0) for c in np.flatnonzero(large)])
        centre /= np.sqrt((centre**2).sum(1, keepdims=True)) + 1e-9
    return np.argmax(x @ centre.T, 1)


def _blocks_of(batch: Batch, most: int) -> Iterator[dict]:
    """A batch as blocks of up to `most` queries of one kind."""
    kind = kinds(batch)
    order = np.argsort(batch.doc, kind="stable")
    at = np.searchsorted(batch.doc[order], np.arange(len(batch.ids) + 1))
    for c in np.unique(kind):
        of_kind = np.flatnonzero(kind == c)
        for i in range(0, len(of_kind), most):
            some = of_kind[i : i + most]
            size = at[some + 1] - at[some]
            bounds = np.append(0, np.cumsum(size))
            yield {"ids": batch.ids[some], "bounds": bounds, "terms": batch.keys[batch.term[order[np.arange(bounds[-1]) + np.repeat(at[some] - bounds[:-1], size)]]]}


class Shard:
    """An inverted index in memory: impacts (inverse document frequency included) and block maxima."""

    def __init__(self, a: dict, total: int, mean: float):
        self.ids, self.keys, self.doc = a["ids"], a["keys"], a["doc"]
        n = len(self.ids)
        df_here = a["df_here"].astype(np.int64)
        self.start = np.append(0, np.cumsum(df_here))
        idf = np.log(1 + (total - a["df"] + 0.5) / (a["df"] + 0.5))
        tf = a["tf"].astype(float)
        self.weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * a["lengths"][self.doc] / mean)) * np.repeat(idf, df_here)
        frequent = np.flatnonzero(df_here > max(FREQUENT * n, 8))
        self.frequent = np.full(len(self.keys), -1)
        self.frequent[frequent] = np.arange(len(frequent))
        self.blocks = -(-n // BLOCK)
        self.dense = np.zeros((len(frequent), self.blocks * BLOCK))
        row = np.repeat(self.frequent, df_here)
        on = np.flatnonzero(row >= 0)
        self.dense[row[on], self.doc[on]] = self.weight[on]
        self.short = self.dense.astype(np.float32)
        self.block_max = self.short.reshape(len(frequent), self.blocks, BLOCK).max(2)
        #: Sums of 32-bit numbers are this near to the exact ones, and nearer.
        self.slack = 6e-8 * (len(frequent) + 2) * (1 + float(self.dense.sum(0).max(initial=0)))

    def search(self, query_ids: np.ndarray, bounds: np.ndarray, terms: np.ndarray, which: np.ndarray, k: int, best: dict[int, list], cells: int = 1 << 20) -> None:
        """Brings best (query id -> (score, document id), best first) up to date with this shard, by so many pairs of a query and a document at once.

        terms: the queries' distinct ones, in order; which: their numbers, query by query.
        """
        if not len(self.keys) or not len(terms):
            return
        at = np.searchsorted(self.keys, terms)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != terms] = -1
        at = at[which]
        step = max(1, cells // (self.blocks * BLOCK))
        for q in range(0, len(query_ids), step):
            some = bounds[q : q + step + 1]
            owner = np.repeat(np.arange(len(some) - 1), np.diff(some))
            known = at[some[0] : some[-1]]
            on = np.flatnonzero(known >= 0)
            self._search(query_ids[q : q + step], owner[on], known[on], k, best)

    def _search(self, query_ids: np.ndarray, owner: np.ndarray, at: np.ndarray, k: int, best: dict[int, list]) -> None:
        m, n, width = len(query_ids), len(self.ids), self.blocks * BLOCK
        f = self.frequent[at]
        # essential terms: all postings
        rare, who = at[f < 0], owner[f < 0]
        size = self.start[rare + 1] - self.start[rare]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        posting = np.repeat((self.start[rare] - (end - size)).astype(np.int32), size)
        posting += np.arange(total, dtype=np.int32)
        cell = np.repeat((who * width).astype(np.int32), size)
        cell += self.doc[posting]
        partial = np.bincount(cell, self.weight[posting], m * width).reshape(m, width)
        # frequent terms: blocks that can't bring a document above a query's k-th best are passed over
        who, common = owner[f >= 0], f[f >= 0]
        used, common = np.unique(common, return_inverse=True)
        has = np.zeros((m, len(used)), np.float32)
        has[who, common] = 1
        tops = [best.setdefault(q, []) for q in query_ids.tolist()]
        limit = np.array([t[k - 1][0] if len(t) >= k else 0.0 for t in tops]) - self.slack - _MARGIN
        bound = has @ self.block_max[used] + partial.reshape(m, self.blocks, BLOCK).max(2)
        bound[bound <= np.maximum(limit, 0)[:, None]] = 0
        rows, open_ = np.flatnonzero(bound.any(1)), np.flatnonzero(bound.any(0))
        if not len(open_):
            return
        columns = (open_[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        columns = columns[columns < n]
        if len(columns) == n and len(rows) == m:
            near = has @ self.short[used, :n]
            near += partial[:, :n]
        else:
            near = has[rows] @ self.short[np.ix_(used, columns)]
            near += partial[np.ix_(rows, columns)]
        own = np.flatnonzero(np.isin(query_ids[rows], self.ids))
        near[own] = np.where(self.ids[columns] == query_ids[rows[own], None], 0, near[own])
        at_least = limit[rows]
        if len(columns) > k:  # a query's k-th best of here is a limit too
            fresh = np.flatnonzero([len(tops[q]) < k for q in rows.tolist()])
            at_least[fresh] = np.maximum(at_least[fresh], np.partition(near[fresh], len(columns) - k, axis=1)[:, len(columns) - k] - 2 * self.slack)
        r, c = np.nonzero(near > np.maximum(at_least, 0)[:, None])
        if not len(r):
            return
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        for i, to in zip(first.tolist(), np.append(first[1:], len(r)).tolist()):
            q, docs = int(rows[r[i]]), columns[c[i:to]]
            full = partial[q, docs] + self.dense[np.ix_(used[has[q] > 0], docs)].sum(0)
            fine = full > 0
            top = tops[q]
            top += zip(np.round(full[fine], 9).tolist(), self.ids[docs[fine]].tolist())
            top.sort(key=lambda x: (-x[0], x[1]))
            del top[k:]


def _document_frequencies(keys: np.ndarray, values: list, part: np.ndarray):
    order, new = groups(keys)
    first = np.flatnonzero(new)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(np.add.reduceat(values[0][order].astype(np.int64), first), np.diff(np.append(first, len(order))))
    return out, None


def search(docs: DataFrame, query_filter: str, k: int = 10, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 8 << 20, shard_rows: int = 16384, query_block: int = 2048) -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best rows by BM25 for each row that query_filter (SQL on `k`, the id) picks.

    A query is the set of its text's words (`[^\\x20\\x09-\\x0D]+`, A to Z lower-cased); rows of its own id are
    left out, and so are rows of score 0. Scores are rounded to 9 decimals; ties go to the smaller id. Rows of
    null id take no part; null text counts as empty, and an empty query has no result. Rows that repeat an
    id are documents each; of queries that repeat an id the text that sorts first counts. An empty table gives an empty
    result. A shard holds shard_bytes of text, or shard_rows of shorter ones.
    """
    rows = docs.where(F.col(f"`{id_col}`").isNotNull())
    source = rows.selectExpr(f"cast(`{id_col}` as long) as k", f"coalesce(`{text_col}`, '') as t")
    batches = written(as_batches(source, {"k": "k", "t": "t"}, shard_bytes, most_rows=shard_rows), "bm25-batches")
    tasks = tasks_for(docs)
    buckets = 4 * tasks

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {0: 0, 1: 0}
        for b, part, _ in gathered(parts):
            batch = Batch(part)
            sums[0] += part.num_rows
            sums[1] += int(batch.lengths.sum())
            yield questions(b, buckets, batch.keys, batch.df.astype(np.uint32))
        yield figures_of(sums, buckets)

    df = written(answered(batches.mapInArrow(ask, batches.schema), [np.uint32], _document_frequencies, 1, tasks), "bm25-df")
    figures = figure_sums(df)
    total = figures.get(0, 0)
    mean = max(figures.get(1, 0) / max(total, 1), 1e-9)

    def index(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, part, answers in gathered(parts):
            batch = Batch(part)
            whole, kind, shards = aligned(answers, 1, np.int64), kinds(batch), []
            for c in np.unique(kind):
                mine = kind == c
                number = np.cumsum(mine) - 1
                on = mine[batch.doc]
                used, df_here = np.unique(batch.term[on], return_counts=True)
                shards.append(dict(ids=batch.ids[mine], lengths=batch.lengths[mine].astype(np.int32), keys=batch.keys[used], df=whole[used], df_here=df_here.astype(np.int32), doc=number[batch.doc[on]].astype(np.int32), tf=batch.tf[on].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([_packed(shards=shards)], pa.binary())], ["data"])

    made = written(together(batches, df).mapInArrow(index, "data binary"), "bm25-index")
    asked = written(source.where(query_filter).groupBy("k").agg(F.min("t").alias("t")), "bm25-asked")

    def as_queries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Few large query blocks, so that a shard is handed out for each of few."""
        held: list[dict] = []
        size = 0
        for part in slices(parts, "t", shard_bytes):
            for block in _blocks_of(Batch(part), query_block):
                if held and size + len(block["ids"]) > query_block:
                    yield _merged(held)
                    held, size = [], 0
                held.append(block)
                size += len(block["ids"])
        if held:
            yield _merged(held)

    blocks = written(asked.repartition(max(1, -(-asked.count() // (2 * query_block)))).mapInArrow(as_queries, "data binary"), "bm25-queries")

    def run(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        shards, now = [], None
        for pair in pairs:
            for i in range(pair.num_rows):
                data = pair.column("shard")[i].as_buffer()
                if now is None or not data.equals(now):
                    shards, now = [Shard(a, total, mean) for a in _unpacked(data)["shards"]], data
                q = _unpacked(pair.column("query")[i].as_buffer())
                for shard in shards:
                    shard.search(**q, k=k, best=best)
        flat = [(q, d, s) for q, top in best.items() for s, d in top]
        columns = list(zip(*flat)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "doc_id", "score"])

    # blocks of a stated query set against all shards
    at_a_time = max(-(-24 // max(1, blocks.rdd.getNumPartitions())), made.count() // 8)  # several shards a task, as a query's best of one limit the next
    pairs = made.coalesce(at_a_time).select(F.col("data").alias("shard")).join(blocks.select(F.col("data").alias("query")))
    found = pairs.mapInArrow(run, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
