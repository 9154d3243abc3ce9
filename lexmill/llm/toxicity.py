"""Toxicity: a sparse linear classifier, regularised by counterfactual swaps of identity terms.

Terms that stand for one another are of two kinds. IDENTITY lists common names of groups of people. As a corpus has
names of its own, which no list knows, words that fill the same place of labelled sentences (between the same two
neighbours) are taken as well, if texts of both labels have them and their share of toxic texts isn't significant: what
such mentions say of a text is chance, so that swapping one for another mustn't change its score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.arrow_text import letter_table, mix, slices, text_buffers, words
from lexmill.llm.exchange import groups as grouped
from lexmill.llm.labelled import labelled_sample
from lexmill.llm.storage import written

#: Groups of words that name people; within a group one stands for another.
IDENTITY: Sequence[Sequence[str]] = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "transgender", "bisexual", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"),
    ("femmes", "hommes", "musulmans", "juifs", "chrétiens"),
    ("frauen", "männer", "muslime", "juden", "christen"),
    ("mujeres", "hombres", "musulmanes", "judíos", "cristianos"),
)
SCHEMA = "doc_id long, score double, predicted int"


#: Words longer than this many bytes also count by their first bytes, so that stems are known under any ending.
PREFIXES = (5, 6, 7, 8)
_PREFIX_BASE = np.uint64(0xD1342543DE82EF95)


def word_hashes(terms: Sequence[str]) -> np.ndarray:
    buf, offsets = text_buffers(pa.array(list(terms)))
    return words(buf, offsets[:-1], letter_table())[2]


def prefix_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length in PREFIXES: which words are longer, and a hash of their first bytes (letters in lower case)."""
    table = letter_table()
    which = np.flatnonzero(ends - starts > PREFIXES[0])
    h = np.zeros(len(which), np.uint64)
    for n in range(PREFIXES[-1]):
        if n in PREFIXES:
            yield which, mix(h + np.uint64(n))
            longer = ends[which] - starts[which] > n + 1
            which, h = which[longer], h[longer]
        h = (h + table[buf[starts[which] + n]].astype(np.uint64)) * _PREFIX_BASE
    yield which, mix(h + np.uint64(PREFIXES[-1]))


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each word and each prefix, as often as they occur."""
    buf, offsets = text_buffers(text)
    starts, ends, h = words(buf, offsets[:-1], letter_table())
    doc = np.searchsorted(offsets, starts, side="right") - 1
    parts = [(doc, h), *[(doc[which], x) for which, x in prefix_hashes(buf, starts, ends)]]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def distinct_features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    doc, h = features(text)
    order, new = grouped(doc, h)
    order = order[new]
    return doc[order], h[order]


@dataclass
class SparseModel:
    """logit = bias + sum of the weights of the text's distinct words and prefixes; hashes ascend."""

    bias: float
    hashes: np.ndarray
    weights: np.ndarray

    def logits(self, text: pa.Array) -> np.ndarray:
        total = np.full(len(text), self.bias)
        if len(self.hashes):
            doc, at = held(text, self.hashes)
            total += np.bincount(doc, self.weights[at], len(text))
        return total


def held(text: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and place in hashes (ascending) of each distinct feature of a text that is among them."""
    doc, h = features(text)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    hit = hashes[at] == h
    once = np.unique(doc[hit] * len(hashes) + at[hit])
    return once // len(hashes), once % len(hashes)


def swaps(text: pa.Array, groups: Sequence[Sequence[str]]) -> dict[tuple[int, int], int]:
    """How often a sentence holds one identity term and could hold another: (hash, hash) and count.

    Swapping a term changes one word of the sentence, so a linear score changes by the difference of
    the two weights: the pairs and their counts are all that the penalty needs.
    """
    hashed = [word_hashes(g) for g in groups]
    buf, offsets = text_buffers(text)
    starts, _, h = words(buf, offsets[:-1], letter_table())
    out: dict[tuple[int, int], int] = {}
    for g in hashed:
        for a in np.flatnonzero(np.isin(h, g)):
            for b in g[g != h[a]]:
                key = (int(h[a]), int(b))
                out[key] = out.get(key, 0) + 1
    return out


#: Above this distance from the usual share of toxic texts, in standard deviations, a word is no neutral mention.
NEUTRAL = 3.0


def standing_out(counts: DataFrame, positives: int, rows: int, least_docs: int, most_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most_words features in at least least_docs texts whose share of texts of label 1 stands out most, and which are neutral.

    counts: (h, df, positive). No more than most_words rows come to the driver.
    """
    rate = positives / rows
    distance = F.abs(F.col("positive") - rate * F.col("df")) / F.sqrt(rate * (1 - rate) * F.col("df"))
    neutral = (distance < NEUTRAL) & (F.col("positive") > 0) & (F.col("positive") < F.col("df"))
    found = counts.where(F.col("df") >= least_docs).select("h", distance.alias("z"), neutral.alias("neutral")).where("z > 1").orderBy(F.desc("z"), "h").limit(most_words).collect()
    found.sort(key=lambda r: r.h % (1 << 64))
    return np.array([r.h for r in found], np.int64).view(np.uint64), np.array([r.neutral for r in found], bool)


def interchangeable(sample: DataFrame, neutral: np.ndarray, most_pairs: int) -> dict[tuple[int, int], int]:
    """Pairs of neutral words (hashes, ascending) that fill the same place in labelled sentences, and how often: the most_pairs most frequent.

    Of a place's words each is paired with the next, a linear number; no place has more words than there are neutral ones.
    """
    if not len(neutral):
        return {}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 21):
            buf, offsets = text_buffers(batch.column("t"))
            starts, _, h = words(buf, offsets[:-1], letter_table())
            doc = np.searchsorted(offsets, starts, side="right") - 1
            i = np.flatnonzero(neutral[np.minimum(np.searchsorted(neutral, h), len(neutral) - 1)] == h)
            i = i[(i > 0) & (i < len(h) - 1)]
            i = i[(doc[i - 1] == doc[i]) & (doc[i + 1] == doc[i])]
            place = mix(mix(h[i - 1]) * np.uint64(3) + h[i + 1])
            order, new = grouped(place, h[i])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(order)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place[order[at]].view(np.int64), h[i][order[at]].view(np.int64), n.astype(np.int64))], ["place", "h", "n"])

    fillers = sample.mapInArrow(places, "place long, h long, n long").groupBy("place", "h").agg(F.sum("n").alias("n"))
    lists = fillers.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("h", "n"))).alias("f")).where("size(f) > 1")
    pairs = lists.select(F.explode(F.expr("transform(sequence(0, size(f) - 2), i -> struct(f[i].h as a, f[i + 1].h as b, least(f[i].n, f[i + 1].n) as n))")).alias("p"))
    found = pairs.groupBy("p.a", "p.b").agg(F.sum("p.n").alias("n")).orderBy(F.desc("n"), "a", "b").limit(most_pairs).collect()
    return {(r.a % (1 << 64), r.b % (1 << 64)): r.n for r in found}


def fit(doc: np.ndarray, column: np.ndarray, y: np.ndarray, hashes: np.ndarray, pairs: dict[tuple[int, int], int], lasso: float = 5e-4, ridge: float = 1e-5, swap_weight: float = 1.0, steps: int = 400) -> SparseModel:
    """Accelerated proximal gradient on: logistic loss + lasso |w| + ridge w^2 + swap_weight * mean (score change)^2.

    Text doc[i] has the feature hashes[column[i]]; both classes weigh the same.
    """
    n, k = len(y), len(hashes)
    if not n or y.min() == y.max():
        return SparseModel(float(np.log((y.sum() + 1) / (n - y.sum() + 1))), np.zeros(0, np.uint64), np.zeros(0))
    pair_list = [(a, b, c) for (a, b), c in pairs.items()]
    ends = [np.searchsorted(hashes, np.array([p[i] for p in pair_list], np.uint64)) for i in (0, 1)]
    inside = [np.zeros(0, bool)] * 2
    if pair_list and k:
        inside = [hashes[np.minimum(e, k - 1)] == np.array([p[i] for p in pair_list], np.uint64) for i, e in enumerate(ends)]
        ends = [np.minimum(e, k - 1) for e in ends]
    times = np.array([p[2] for p in pair_list], float) / max(1, sum(p[2] for p in pair_list))
    balance = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    width = np.bincount(doc, minlength=n).max(initial=1) + 1
    step = 1 / (0.25 * min(width, WIDTH) + 2 * ridge + 4 * swap_weight)
    w, v, bias, vb, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    for _ in range(steps):
        logit = vb + np.bincount(doc, v[column], n)
        error = balance * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
        gradient = np.bincount(column, error[doc], k) + 2 * ridge * v
        if pair_list and k:
            change = np.where(inside[0], v[ends[0]], 0) - np.where(inside[1], v[ends[1]], 0)
            for i, sign in ((0, 1), (1, -1)):
                np.add.at(gradient, ends[i][inside[i]], 2 * swap_weight * sign * (times * change)[inside[i]])
        new = v - step * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        new_bias = vb - step * error.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    some = w != 0
    return SparseModel(float(bias), hashes[some], w[some])


#: The step is set by the widest text, up to so many features: few of them carry weight, so longer texts converge as well.
WIDTH = 200


def train(docs: DataFrame, labels: DataFrame, keep: F.Column, most: int = 12_000, label: str = "toxic", groups: Sequence[Sequence[str]] = IDENTITY, least_docs: int = 4, most_words: int = 20_000,
          swap_weight: float = 1.0, most_pairs: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> SparseModel:
    """Fit on at most `most` labelled rows. Counts of features come to the driver, which of the chosen ones each text has, and at most most_pairs pairs; no texts do.

    Prefixes of identity terms are no features, so that a swap changes words only, which the penalty covers.
    """
    sample = written(labelled_sample(docs, labels, label, keep, most, id_col, text_col), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 21):
            doc, h = distinct_features(batch.column("t"))
            found, which = np.unique(h, return_inverse=True)
            positive = np.bincount(which, batch.column("y").to_numpy()[doc], len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(which, minlength=len(found)), pa.int64()), pa.array(positive)], ["h", "df", "positive"])

    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("positive")).first()
    if not total.n or total.positive in (0, total.n):
        return fit(np.zeros(0, int), np.zeros(0, int), np.repeat([1.0, 0.0], [total.positive, total.n - total.positive]), np.zeros(0, np.uint64), {})
    counts = sample.mapInArrow(count, "h long, df long, positive long").groupBy("h").agg(F.sum("df").alias("df"), F.sum("positive").alias("positive"))
    hashes, neutral = standing_out(counts, total.positive, total.n, least_docs, most_words)
    terms = pa.array([t for g in groups for t in g] or [""])
    stay = ~np.isin(hashes, np.setdiff1d(features(terms)[1], word_hashes([t for g in groups for t in g] or [""])))
    hashes, neutral = hashes[stay], neutral[stay]
    mined = interchangeable(sample, hashes[neutral], most_pairs)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 21):
            doc, column = held(batch.column("t"), hashes) if len(hashes) else (np.zeros(0, int), np.zeros(0, int))
            found = swaps(batch.column("t"), groups)
            pairs = np.array([(a, b, c) for (a, b), c in found.items()], np.uint64).reshape(-1, 3)
            packed = [x.tobytes() for x in (doc.astype(np.int32), column.astype(np.int32), pairs, batch.column("y").to_numpy().astype(np.float64), batch.column("k").to_numpy())]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], ["doc", "column", "pairs", "y", "k"])

    got = sample.mapInArrow(chosen, "doc binary, column binary, pairs binary, y binary, k binary").collect()
    got.sort(key=lambda g: bytes(g["k"]))  # the order of tasks doesn't matter
    ys = [np.frombuffer(g["y"], float) for g in got]
    before = np.cumsum([0, *map(len, ys)])
    pairs = dict(mined)
    for g in got:
        for a, b, c in np.frombuffer(g["pairs"], np.uint64).reshape(-1, 3).tolist():
            pairs[a, b] = pairs.get((a, b), 0) + c
    doc = np.concatenate([np.frombuffer(g["doc"], np.int32).astype(np.int64) + at for g, at in zip(got, before)])
    column = np.concatenate([np.frombuffer(g["column"], np.int32).astype(np.int64) for g in got])
    return fit(doc, column, np.concatenate(ys), hashes, pairs, swap_weight=swap_weight)


def score(docs: DataFrame, model: SparseModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, score in [0, 1] (higher: label 1 likelier) and predicted for each row of docs.

    Whole texts; null counts as empty, and empty texts get a score as well; a null id stays null; repeated
    rows are scored each; other columns are ignored; an empty table gives an empty result. The model
    travels with the tasks (at most most_words weights); no row is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 21):
            p = 1 / (1 + np.exp(-np.clip(model.logits(batch.column("t")), -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as k", f"`{text_col}` as t").mapInArrow(run, SCHEMA)
