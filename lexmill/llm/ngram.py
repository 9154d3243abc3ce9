"""Language-model scores by deleted interpolation of n-gram maximum-likelihood estimates.

P(w | v) = l2(b) c(v,w)/c(v) + l1(b) c(w)/N + l0(b)/(V+1), where b is the bucket of the context's
frequency c(v). The weights of a bucket come from expectation-maximisation on held-out counts: each
training token is held out in turn, so it is scored by the counts without itself (c - 1), and its
context falls into the bucket of c(v) - 1. Over all words and one unknown the probabilities of a
context add up to 1.

Counts are gathered over the whole corpus by lexmill.llm.exchange: first of words, then of pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm.arrow_text import lower_table, mix, text_buffers, words
from lexmill.llm.exchange import aligned, answered, as_batches, figure_sums, figures_of, gathered, groups, questions, tasks_for, together
from lexmill.llm.storage import written

#: Context frequencies by octaves: 0, 1, 2-3, 4-7, ...
CONTEXTS = 24
#: Levels of log2 of the pair estimate (half octaves, 0 for zero) and of the word estimate (octaves).
PAIR_LEVELS, WORD_LEVELS = 64, 48
_END = np.uint64(0x2545F4914F6CDD1D)
_START = np.uint64(0x9E6C63D0876A9A47)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def fold(doc_id: int | None, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(float))[1], CONTEXTS - 1)


def estimate_cell(context: np.ndarray, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Number of the cell for a context bucket and two estimates (0 <= pair <= 1, 0 <= word <= 1)."""
    with np.errstate(divide="ignore"):
        x2 = np.where(pair > 0, np.clip(1 - np.round(2 * np.log2(pair)), 1, PAIR_LEVELS - 1), 0)
        x1 = np.where(word > 0, np.clip(1 - np.round(np.log2(word)), 1, WORD_LEVELS - 1), 0)
    return ((context * PAIR_LEVELS + x2) * WORD_LEVELS + x1).astype(np.int64)


@dataclass
class Weights:
    """A row (pair, word, uniform) for each context bucket."""

    table: np.ndarray

    @staticmethod
    def learn(cells: dict[int, int], vocabulary: int, rounds: int = 60) -> Weights:
        """Expectation-maximisation over the cells' counts; a bucket without any takes its lower neighbour's."""
        table = np.full((CONTEXTS, 3), 1 / 3)
        table[0] = 0, 2 / 3, 1 / 3
        cell = np.fromiter(cells.keys(), np.int64, len(cells))
        count = np.fromiter(cells.values(), float, len(cells))
        context, x2, x1 = cell // (PAIR_LEVELS * WORD_LEVELS), cell // WORD_LEVELS % PAIR_LEVELS, cell % WORD_LEVELS
        each = np.stack([np.where(x2 > 0, 2.0 ** ((1 - x2) / 2), 0), np.where(x1 > 0, 2.0 ** (1.0 - x1), 0), np.full(len(cell), 1 / (vocabulary + 1))], 1)
        for b in range(CONTEXTS):
            here = context == b
            if not here.any():
                if b:
                    table[b] = table[b - 1]
                continue
            f, n, w = each[here], count[here], table[b].copy()
            for _ in range(rounds):
                share = w * f
                share /= share.sum(1, keepdims=True)
                w = (n[:, None] * share).sum(0) / n.sum()
            w = np.maximum(w, [0 if b == 0 else 1e-6, 1e-6, 1e-6])  # no known or unknown word may become impossible
            table[b] = w / w.sum()
        return Weights(table)


class Batch:
    """The tokens of a batch's texts: each text's words, then one end."""

    def __init__(self, docs: pa.RecordBatch, folds: int):
        buf, offsets = text_buffers(docs.column("t"))
        starts, _, h = words(buf, offsets[:-1], lower_table())
        n_words = np.bincount(np.searchsorted(offsets, starts, side="right") - 1, minlength=docs.num_rows)
        self.ids = docs.column("k")
        self.sizes = n_words + 1
        self.doc = np.repeat(np.arange(docs.num_rows), self.sizes)
        last = np.cumsum(self.sizes) - 1
        tokens = np.full(len(self.doc), _END)
        is_word = np.ones(len(self.doc), bool)
        is_word[last] = False
        tokens[is_word] = h
        self.train = np.array([fold(k, folds) != 0 for k in self.ids.to_pylist()], bool)
        self.keys, self.which = np.unique(tokens, return_inverse=True)
        self.in_training = self.train[self.doc]
        self.counts = np.bincount(self.which[self.in_training], minlength=len(self.keys))
        context = np.full(len(self.doc), _START)
        context[1:] = tokens[:-1]
        context[0 : 1 if len(context) else 0] = _START
        context[last[:-1] + 1] = _START
        self.tokens, self.context = tokens, context

    def with_words(self, total: np.ndarray) -> Pairs:
        return Pairs(self, total)


class Pairs:
    """Distinct pairs (context, word) of a batch, with the corpus counts of both."""

    def __init__(self, batch: Batch, total: np.ndarray):
        self.word_count = total[batch.which]
        end = np.searchsorted(batch.keys, _END)
        starts = total[end] if end < len(total) and batch.keys[end] == _END else 0  # as many texts start as end
        count = np.empty_like(self.word_count)
        count[1:] = self.word_count[:-1]
        is_start = batch.context == _START
        count[is_start] = starts
        self.context_count = count
        keys = mix(mix(batch.context) * np.uint64(3) + batch.tokens)
        self.keys, first, self.which = np.unique(keys, return_index=True, return_inverse=True)
        self.here = np.bincount(self.which[batch.in_training], minlength=len(self.keys))
        self.word, self.before = self.word_count[first], self.context_count[first]
        #: Elsewhere a pair can only be if each of its words is.
        self.open = np.minimum(self.word, self.before) > self.here


def coded(count: np.ndarray) -> np.ndarray:
    """Counts from 1 by eighths of an octave: enough for the weights, in a byte."""
    return np.clip(np.round(8 * np.log2(np.maximum(count, 1))), 0, 255).astype(np.uint8)


def decoded(code: np.ndarray) -> np.ndarray:
    return np.rint(2 ** (code / 8))


def cells_of(pair: np.ndarray, before: np.ndarray, word: np.ndarray, train_tokens: int) -> list[tuple[int, int]]:
    """Cells and how many held-out tokens fall into each: every pair's occurrences, by counts without themselves."""
    some = pair > 0
    pair, before, word = pair[some], before[some], word[some]
    cell = estimate_cell(context_bucket(before - 1), (pair - 1) / np.maximum(before - 1, 1), (word - 1) / max(train_tokens - 1, 1))
    found, which = np.unique(cell, return_inverse=True)
    return list(zip(found.tolist(), np.bincount(which, pair, len(found)).astype(np.int64).tolist()))


def _word_totals(keys: np.ndarray, values: list, part: np.ndarray):
    order, new = groups(keys)
    first = np.flatnonzero(new)
    sums = np.add.reduceat(values[0][order].astype(np.int64), first)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(sums, np.diff(np.append(first, len(order))))
    return out, [(0, int(sums.sum())), (1, int((sums > 0).sum()))]


def score_texts(docs: DataFrame, folds: int = 10, alpha: float = 0.1, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """Per row of docs: base_score by smoothed word counts, and score, log10 P(text) of the interpolated model.

    The model learns from rows whose crc32(id as text) mod folds is not 0; a null id counts as the empty
    text, so its rows are held out. A to Z are lower-cased; tokens are the words `[^\\x20\\x09-\\x0D]+` and one
    end. Null text counts as empty (the end alone). Repeated rows count and are scored each; other columns
    are ignored; an empty table gives an empty result. Without any training row all counts are 0, and
    the score is that of the uniform part.
    """
    batches = written(as_batches(docs, {"k": f"cast(`{id_col}` as long)", "t": f"`{text_col}`"}, batch_bytes), "ngram-batches")
    tasks = tasks_for(docs)
    buckets = 4 * tasks

    def ask_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, part, _ in gathered(rows):
            batch = Batch(part, folds)
            yield questions(b, buckets, batch.keys, batch.counts.astype(np.uint32))

    totals = written(answered(batches.mapInArrow(ask_words, batches.schema), [np.uint32], _word_totals, 1, tasks), "ngram-words")
    figures = figure_sums(totals)
    n, v = figures.get(0, 0), figures.get(1, 0)

    def ask_pairs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closed: dict[int, int] = {}
        for b, part, answers in gathered(rows):
            pairs = Batch(part, folds).with_words(aligned(answers, 1, np.int64))
            o = pairs.open
            for c, k in cells_of(pairs.here[~o], pairs.before[~o], pairs.word[~o], n):
                closed[c] = closed.get(c, 0) + k
            yield questions(b, buckets, pairs.keys[o], pairs.here[o].astype(np.uint32), coded(pairs.before[o]), coded(pairs.word[o]))
        yield figures_of(closed, buckets)

    def pair_totals(keys: np.ndarray, values: list, part: np.ndarray):
        here, before, word = values
        order, new = groups(keys)
        first = np.flatnonzero(new)
        sums = np.add.reduceat(here[order].astype(np.int64), first)
        out = np.empty(len(keys), np.int64)
        out[order] = np.repeat(sums, np.diff(np.append(first, len(order))))
        return out, cells_of(sums, decoded(before[order][first]), decoded(word[order][first]), n)

    pair_counts = written(answered(together(batches, totals).mapInArrow(ask_pairs, batches.schema), [np.uint32, np.uint8, np.uint8], pair_totals, 2, tasks), "ngram-pairs")

    learnt = Weights.learn(figure_sums(pair_counts), v).table  # at most CONTEXTS * PAIR_LEVELS * WORD_LEVELS cells

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, answers in gathered(rows):
            batch = Batch(part, folds)
            pairs = batch.with_words(aligned(answers, 1, np.int64))
            pair = pairs.here.astype(np.int64)
            pair[pairs.open] = aligned(answers, 2, np.int64)
            c1, cv, c2 = pairs.word_count, pairs.context_count, pair[pairs.which]
            w = learnt[context_bucket(cv)]
            p = w[:, 0] * c2 / np.maximum(cv, 1) + w[:, 1] * c1 / max(n, 1) + w[:, 2] / (v + 1)
            size = part.num_rows
            base = np.log10((c1 + alpha) / (n + alpha * (v + 1)))
            held_out = pa.array(~batch.train)
            columns = [batch.ids, held_out, pa.array(batch.sizes, pa.int64()), pa.array(np.bincount(batch.doc[c1 > 0], minlength=size), pa.int64()), pa.array(np.full(size, n), pa.int64())]
            columns += [pa.array(np.bincount(batch.doc, x, size)) for x in (base, np.log10(p))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return together(batches, totals, pair_counts).mapInArrow(finish, SCHEMA)
