"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Each table has a pseudo-rotation of its own (random signs and a fast Hadamard transform, three times).
A vector's bucket is its nearest signed axis. A query probes a table's axes in falling order of its own
rotated coordinates; the vectors in the buckets that it probes, of all tables, are compared by their exact cosines, and
no others. The bucket lists are built once per shard of vectors and written with it; a query's shard results
merge by score, so no bucket ever leaves its shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.arrow_text import worker_cache
from lexmill.llm.storage import written

SCHEMA = "query_id long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row (their length is a power of two)."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class Tables:
    """Pseudo-rotations of `tables` tables for vectors of `dim` components."""

    def __init__(self, dim: int, tables: int, seed: int):
        self.size = 1 << max(0, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.size))

    def rotated(self, unit: np.ndarray, table: int) -> np.ndarray:
        x = np.zeros((len(unit), self.size))
        x[:, : unit.shape[1]] = unit
        for s in self.signs[table]:
            x = hadamard(x * s)
        return x

    def axes(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Nearest signed axis: i for +e_i, size + i for -e_i."""
        x = self.rotated(unit, table)
        i = np.abs(x).argmax(1)
        return np.where(x[np.arange(len(x)), i] >= 0, i, self.size + i)

    def probes(self, unit: np.ndarray, table: int, number: int) -> np.ndarray:
        """The `number` signed axes nearest to each vector."""
        x = self.rotated(unit, table)
        both = np.concatenate([x, -x], 1)
        return np.argpartition(-both, min(number, both.shape[1]) - 1, 1)[:, :number]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; alike rows give alike values."""
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def bucket_lists(vectors: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """For each table the places of the vectors in order of their buckets, and where each bucket begins and ends there."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    order = np.empty((len(tables.signs), len(vectors)), np.int32)
    bounds = np.empty((len(tables.signs), 2 * tables.size + 1), np.int32)
    for t in range(len(tables.signs)):
        axes = tables.axes(unit, t)
        order[t] = np.argsort(axes, kind="stable")
        bounds[t] = np.searchsorted(axes[order[t]], np.arange(2 * tables.size + 1))
    return order, bounds


def nearest_in_shard(ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, bounds: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, tables: Tables, probes: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest candidates in the shard for each query: query ids, vector ids, cosines. Where its buckets hold fewer than k, all vectors are candidates."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    query_unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    probed = [tables.probes(query_unit, t, probes) for t in range(len(tables.signs))]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    hit = np.zeros(len(vectors), bool)
    for q in range(len(queries)):
        hit[:] = False
        for t, axes in enumerate(probed):
            for a in axes[q].tolist():
                hit[order[t, bounds[t, a] : bounds[t, a + 1]]] = True
        hit &= ids != query_ids[q]
        c = np.flatnonzero(hit)
        if len(c) < k:
            c = np.flatnonzero(ids != query_ids[q])
        if len(c) > k:
            s = unit[c] @ query_unit[q]
            c = c[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9]  # ties, whatever the order of the sums, come along
        score = cosines(np.broadcast_to(queries[q], (len(c), queries.shape[1])), vectors[c])
        best = np.lexsort((ids[c], -score))[:k]
        out.append((np.full(len(best), query_ids[q]), ids[c[best]], score[best]))
    return tuple(np.concatenate([o[i] for o in out] or [np.zeros(0, t)]) for i, t in enumerate((np.int64, np.int64, float)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v as double array) of the rows whose vector is not null, not zero, and finite throughout."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def blocks(rows: DataFrame, dim: int, most: int, tables: int = 0, seed: int = 0) -> DataFrame:
    """(n long, ids binary, v binary, place binary, bounds binary): up to `most` vectors of `dim` components a row, with their bucket lists in so many tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            vectors = np.concatenate(parts)
            lists = bucket_lists(vectors.reshape(-1, dim), Tables(dim, tables, seed)) if tables else (np.zeros(0), np.zeros(0))
            data = [np.concatenate(ids), vectors, *lists]
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in data]], ["n", "ids", "v", "place", "bounds"])

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if size + part.num_rows > most:
                    yield flush()
                    ids, parts, size = [], [], 0
                ids.append(part.column("id").to_numpy())
                parts.append(part.column("v").flatten().to_numpy())
                size += part.num_rows
        if size:
            yield flush()

    return rows.where(F.size("v") == dim).mapInArrow(run, "n long, ids binary, v binary, place binary, bounds binary")


def search(vectors: DataFrame, query_filter: str, k: int = 5, tables: int = 32, probe_share: float = 1 / 64, seed: int = 11, shard_rows: int = 8192, query_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found by cosine for each row that query_filter (on `id`) picks.

    probe_share of a table's signed axes are probed. Rows whose vector is null, empty or zero, or has
    null or non-finite components, take no part, nor do rows of null id. A query is compared with vectors
    of its own length only, and with all rows but those of its own id. Ties go to the smaller id. Rows that
    repeat an id count as one query (the vector that sorts first) and as a candidate each. A shard in whose probed buckets
    a query finds fewer than k vectors is compared in full, so that all are returned where there are k or fewer. An empty
    table gives an empty result.

    Query blocks meet shards of vectors: each pair of a block and a shard is one task's unit, so either
    side may be of any size.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    dims = [r.d for r in rows.select(F.size("v").alias("d")).distinct().collect()]  # lengths of vectors, not vectors
    found = None
    for dim in sorted(dims):
        shards = written(blocks(rows, dim, shard_rows, tables, seed), "ann-shards")
        asked = rows.where(query_filter).groupBy("id").agg(F.min("v").alias("v"))
        queries = written(blocks(asked, dim, query_rows), "ann-queries")
        query_blocks = queries.select(F.col("ids").alias("q_ids"), F.col("v").alias("q_v"))
        axes = 2 * (1 << max(0, (dim - 1).bit_length()))
        probes = max(1, min(axes, round(probe_share * axes)))

        def run(batches: Iterator[pa.RecordBatch], dim=dim, probes=probes) -> Iterator[pa.RecordBatch]:
            cache = worker_cache("ann")
            key = ("ann", dim, tables, seed)
            if key not in cache:
                cache[key] = Tables(dim, tables, seed)
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, q_ids = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("ids", "q_ids"))
                    v, q_v = (np.frombuffer(batch.column(c)[i].as_buffer(), float).reshape(-1, dim) for c in ("v", "q_v"))
                    place, bounds = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32).reshape(tables, -1) for c in ("place", "bounds"))
                    got = nearest_in_shard(ids, v, place, bounds, q_ids, q_v, cache[key], probes, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["query_id", "vec_id", "score"])

        pairs = shards.select("ids", "v", "place", "bounds").join(query_blocks)  # blocks of a stated query set against all shards
        part = pairs.mapInArrow(run, SCHEMA)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
