"""Hashed keys of document batches meet in buckets, and the answers come back to the batches.

A corpus question such as "how often is this word seen anywhere?" would take a row per occurrence in
a plain shuffle. Here a batch of documents (a few MB of text, one row of a written table) sends its
distinct keys, sorted, as one binary per bucket; a bucket answers each binary with one value per key,
in the same order; and the batch, which can compute its keys again, lines the answers up with them.
Keys are pre-aggregated within a batch, so a key that every document has costs one entry a batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.arrow_text import slices, worker_cache

SCHEMA = "b long, kind int, q int, n1 long, n2 long, data binary"
_NAMES = ["b", "kind", "q", "n1", "n2", "data"]
#: The kind of rows that hold a batch; answers have lower ones and so come first.
DOCUMENTS = 9
#: The kind of rows that hold figures of a bucket instead of an answer.
FIGURES = 8


def tasks_for(df: DataFrame, task_bytes: int = 64 << 20) -> int:
    """The session's shuffle partitions, or more if the input by Spark's estimate needs them."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(most, min(1_000_000, math.ceil(size / task_bytes))) if size < 1 << 60 else most


def squeeze(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unsqueeze(data, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def rows_of(b, kind, q, n1, n2, data) -> pa.RecordBatch:
    long, int_ = pa.int64(), pa.int32()
    return pa.RecordBatch.from_arrays([pa.array(b, long), pa.array(kind, int_), pa.array(q, int_), pa.array(n1, long), pa.array(n2, long), pa.array(data, pa.binary())], _NAMES)


def as_batches(docs: DataFrame, columns: dict[str, str], most_bytes: int = 4 << 20, most_rows: int = 1 << 20) -> DataFrame:
    """Rows of kind DOCUMENTS; columns: SQL expression by name, among them ``t``, the text.

    A batch holds about most_bytes of text, at most most_rows documents, or one longer document. Write the result once: batches
    are numbered by the task that cut them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("exchange")
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            return rows_of([number], [DOCUMENTS], [0], [table.num_rows], [size], [sink.getvalue().to_pybytes()])

        for whole in slices(batches, "t", most_bytes):
            for part in (whole.slice(i, most_rows) for i in range(0, whole.num_rows, most_rows)):
                more = part.column("t").nbytes
                if held and (size + more > most_bytes or sum(h.num_rows for h in held) + part.num_rows > most_rows):
                    yield flush()
                    number += 1
                    held, size = [], 0
                held.append(part)
                size += more
        if held:
            yield flush()

    return docs.select(*[F.expr(e).alias(n) for n, e in columns.items()]).mapInArrow(run, SCHEMA)


def documents_of(data) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()[0]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, dict[int, list]]]:
    """From rows sorted by (b, kind, q): a batch's number, its documents, and its answers by kind, in order of q."""
    worker_cache("exchange")
    answers: dict[int, list] = {}
    for rows in batches:
        data = rows.column("data")
        for i, (b, kind) in enumerate(zip(rows.column("b").to_pylist(), rows.column("kind").to_pylist())):
            if kind == DOCUMENTS:
                yield b, documents_of(data[i].as_buffer()), answers
                answers = {}
                pa.default_memory_pool().release_unused()
            else:
                answers.setdefault(kind, []).append(data[i].as_buffer())


def aligned(answers: dict[int, list], kind: int, dtype) -> np.ndarray:
    """One value for each key that the batch sent, in the order of the keys."""
    parts = [unsqueeze(x, dtype) for x in answers.get(kind, [])]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def together(documents: DataFrame, *answers: DataFrame) -> DataFrame:
    """The batches and their answers, dealt out by batch and sorted as gathered() needs them."""
    rows = documents
    for a in answers:
        rows = rows.unionByName(a.where(F.col("kind") < FIGURES))
    return rows.repartition(tasks_for(documents), "b").sortWithinPartitions("b", "kind", "q")


def questions(b: int, buckets: int, keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket that any of the keys (sorted, unsigned, by their first 64 bits) falls into."""
    bounds = np.searchsorted(keys >> np.uint64(32), np.array([((q << 32) + buckets - 1) // buckets for q in range(buckets)], np.uint64))
    bounds = np.append(bounds, len(keys)).tolist()
    used = [q for q in range(buckets) if bounds[q] < bounds[q + 1]]
    data = []
    for q in used:
        at = slice(bounds[q], bounds[q + 1])
        parts = [keys[at].tobytes(), *[squeeze(v[at]) for v in values]]
        data.append(b"".join([np.array([len(p) for p in parts], np.int64).tobytes(), *parts]))
    n = len(used)
    return rows_of([b] * n, [0] * n, used, [0] * n, [0] * n, data)


def answered(asked: DataFrame, dtypes: list, answer: Callable, kind: int, tasks: int) -> DataFrame:
    """Each bucket's binaries, put together, go through answer(keys, values, part) once.

    answer returns a value for each entry and a list of (n1, n2) figures, or None; part is the number of the
    binary that an entry came from. Figures are summed by n1 within a task, to one row of kind FIGURES; those
    among the questions come along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        figures: dict[int, int] = {}

        def bucket(q: int, sent: list[tuple[int, pa.Buffer]]) -> pa.RecordBatch:
            columns: list[list[np.ndarray]] = [[] for _ in range(1 + len(dtypes))]
            for _, data in sent:
                sizes = np.frombuffer(data, np.int64, 1 + len(dtypes)).tolist()
                at = 8 * len(sizes)
                columns[0].append(np.frombuffer(data, np.uint64, sizes[0] // 8, at))
                for i, dtype in enumerate(dtypes):
                    at += sizes[i]
                    columns[i + 1].append(unsqueeze(data[at : at + sizes[i + 1]], dtype))
            lengths = [len(x) for x in columns[0]]
            part = np.repeat(np.arange(len(sent), dtype=np.int32), lengths)
            keys, *values = [np.concatenate(x) for x in columns]
            result, more = answer(keys, values, part)
            for n1, n2 in more or ():
                figures[n1] = figures.get(n1, 0) + n2
            bounds = np.cumsum([0, *lengths]).tolist()
            n = len(sent)
            return rows_of([b for b, _ in sent], [kind] * n, [q] * n, [0] * n, [0] * n, [squeeze(result[x:y]) for x, y in zip(bounds, bounds[1:])])

        now, sent = None, []
        for rows in batches:
            data = rows.column("data")
            for i, (b, kind_, q) in enumerate(zip(*[rows.column(c).to_pylist() for c in _NAMES[:3]])):
                if kind_ == FIGURES:
                    _add(figures, data[i].as_buffer())
                    continue
                if q != now and sent:
                    yield bucket(now, sent)
                    sent = []
                now = q
                sent.append((b, data[i].as_buffer()))
        if sent:
            yield bucket(now, sent)
        if figures:
            yield figures_of(figures)

    return asked.repartition(tasks, "q").sortWithinPartitions("q").mapInArrow(run, SCHEMA)


def figures_of(sums: dict[int, int], buckets: int = 1) -> pa.RecordBatch:
    """Sums by number, as one row to go along with a task's questions."""
    data = np.array([list(sums), list(sums.values())], np.int64).tobytes()
    return rows_of([-1], [FIGURES], [TaskContext.get().partitionId() % buckets], [0], [0], [data])


def _add(sums: dict[int, int], data) -> None:
    numbers, values = np.frombuffer(data, np.int64).reshape(2, -1).tolist()
    for n, v in zip(numbers, values):
        sums[n] = sums.get(n, 0) + v


def figure_sums(answers: DataFrame) -> dict[int, int]:
    """All tasks' figures, added up on the executors; as many come to the driver as there are numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for rows in batches:
            for data in rows.column("data"):
                _add(sums, data.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["n1", "n2"])

    rows = answers.where(F.col("kind") == FIGURES).select("data").repartition(8)
    return {r.n1: r.n for r in rows.mapInArrow(run, "n1 long, n2 long").groupBy("n1").agg(F.sum("n2").alias("n")).collect()}


def groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the columns (the first weighs most), and where each new group begins in it."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for c in columns:
            s = c[order]
            new[1:] |= s[1:] != s[:-1]
    return order, new
