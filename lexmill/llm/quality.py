"""Quality classifier: a factorisation machine over hashed words, structure statistics and length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.arrow_text import slices, worker_cache
from lexmill.llm.labelled import STRUCTURE, labelled_sample, structure, word_sets

BUCKETS = 1 << 16
SCHEMA = "doc_id long, score double, predicted int"


@dataclass
class FactorisationMachine:
    """logit = bias + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Linear in the number of (row, feature, value) triples; row ascends."""
        total = self.bias + np.bincount(row, self.weight[feature] * value, n)
        for f in range(self.factor.shape[1]):
            vx = self.factor[feature, f] * value
            total += 0.5 * (np.bincount(row, vx, n) ** 2 - np.bincount(row, vx * vx, n))
        return total


def triples(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of the hashed words (log counts, of unit length a row), and the structure rows."""
    doc, h, count, echoes = word_sets(text)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, value * value, len(text)))
    return doc, (h >> np.uint64(48)).astype(np.int64), value / norm[doc], structure(text, doc, count, echoes)


def with_structure(fm_mean, fm_scale, row, feature, value, rows):
    """The triples with the structure statistics, standardised and clipped, as features from BUCKETS on."""
    n, k = rows.shape
    dense = np.clip((rows - fm_mean) * fm_scale, -4, 4) * 0.5
    row = np.append(row, np.repeat(np.arange(n), k))
    order = np.argsort(row, kind="stable")
    feature = np.append(feature, np.tile(BUCKETS + np.arange(k), n))[order]
    return row[order], feature, np.append(value, dense.ravel())[order]


def fit(batches: list[tuple], y: np.ndarray, factors: int = 4, epochs: int = 8, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the logistic loss, in mini-batches. batches: (row, feature, value, structure) of consecutive rows of y."""
    rng = np.random.default_rng(seed)
    k = len(STRUCTURE)
    rows = np.concatenate([b[3] for b in batches]) if batches else np.zeros((0, k))
    mean = rows.mean(0) if len(rows) else np.zeros(k)
    scale = 1 / np.maximum(rows.std(0), 1e-6) if len(rows) else np.ones(k)
    size = BUCKETS + k
    fm = FactorisationMachine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, factors)), mean, scale)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the share of label 1, smoothed
        fm.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        fm.factor[:] = 0
        return fm
    row = np.concatenate([b[0] + at for b, at in zip(batches, np.cumsum([0, *[len(b[3]) for b in batches[:-1]]]))])
    row, feature, value = with_structure(mean, scale, row, np.concatenate([b[1] for b in batches]), np.concatenate([b[2] for b in batches]), rows)
    bounds = np.searchsorted(row, np.arange(len(y) + 1))
    fm.bias = float(np.log(y.mean() / (1 - y.mean())))
    gw, gv, gb = np.full(size, 1e-8), np.full((size, factors), 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            picked = order[at : at + 64]
            length = bounds[picked + 1] - bounds[picked]
            index = np.repeat(bounds[picked] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
            r, f, x = np.repeat(np.arange(len(picked)), length), feature[index], value[index]
            vx = fm.factor[f] * x[:, None]
            sums = np.stack([np.bincount(r, vx[:, c], len(picked)) for c in range(factors)], 1)
            squares = np.stack([np.bincount(r, vx[:, c] ** 2, len(picked)) for c in range(factors)], 1)
            logit = fm.bias + np.bincount(r, fm.weight[f] * x, len(picked)) + 0.5 * (sums**2 - squares).sum(1)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[picked]) / len(picked)
            used, inverse = np.unique(f, return_inverse=True)
            dw = np.bincount(inverse, error[r] * x, len(used)) + decay * fm.weight[used]
            part = (error[r] * x)[:, None] * (sums[r] - vx)
            dv = np.stack([np.bincount(inverse, part[:, c], len(used)) for c in range(factors)], 1) + decay * fm.factor[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += error.sum() ** 2
            fm.weight[used] -= rate * dw / np.sqrt(gw[used])
            fm.factor[used] -= rate * dv / np.sqrt(gv[used])
            fm.bias -= rate * error.sum() / np.sqrt(gb)
    return fm


def train(docs: DataFrame, labels: DataFrame, keep: F.Column, most: int = 4000, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> FactorisationMachine:
    """Fit on at most `most` labelled rows; their features, not their texts, come to the driver."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 21):
            row, feature, value, rows = triples(batch.column("t"))
            packed = [x.tobytes() for x in (row.astype(np.int32), feature.astype(np.int32), value.astype(np.float32), rows, batch.column("y").to_numpy().astype(np.float64), batch.column("k").to_numpy())]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], ["row", "feature", "value", "rows", "y", "k"])

    sample = labelled_sample(docs, labels, label, keep, most, id_col, text_col)
    got = sample.mapInArrow(features, "row binary, feature binary, value binary, rows binary, y binary, k binary").collect()
    got.sort(key=lambda g: bytes(g["k"]))  # the order of tasks doesn't matter
    load = lambda x, t: np.frombuffer(x, t)
    batches = [(load(g["row"], np.int32).astype(np.int64), load(g["feature"], np.int32).astype(np.int64), load(g["value"], np.float32).astype(float), load(g["rows"], float).reshape(-1, len(STRUCTURE))) for g in got]
    y = np.concatenate([load(g["y"], float) for g in got]) if got else np.zeros(0)
    del got
    return fit(batches, y)


def score(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """doc_id, score in [0, 1] (higher: label 1 likelier) and predicted for each row of docs.

    Whole texts; null counts as empty, and empty texts get a score as well; a null id stays null; repeated
    rows are scored each; an empty table gives an empty result. Columns named in carry come along. The
    model, of a fixed size, travels with the tasks; no row is shuffled.
    """
    carry = carry or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality")
        for batch in slices(batches, "_t", 1 << 21):
            logits = model.logits(*with_structure(model.mean, model.scale, *triples(batch.column("_t"))), batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(logits, -700, 700)))
            columns = [batch.column("_k"), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *[batch.column(f"_c{i}") for i in range(len(carry))]], ["doc_id", "score", "predicted", *[f"_c{i}" for i in range(len(carry))]])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_k"), F.col(f"`{text_col}`").alias("_t"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)])
    more = "".join(f", _c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    return rows.mapInArrow(run, SCHEMA + more).withColumnsRenamed({f"_c{i}": c for i, c in enumerate(carry)})
