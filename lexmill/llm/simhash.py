"""SimHash near-duplicates by the general pigeonhole principle.

The 64 bits are parted into groups of correlated bits. With m groups and thresholds t_1..t_m that add up
to limit - m + 1 (each at least -1), two fingerprints within `limit` bits agree on some group i up to t_i
bits. Dynamic programming picks m and the thresholds of least estimated cost: rows to deal out, and pairs
to compare. Each fingerprint goes to the bucket of its own value in a group, and to those of the larger
values within the threshold; the fingerprints of a bucket are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import exchange
from lexmill.llm.arrow_text import chained, lower_table, mix, slices, text_buffers, words, worker_cache
from lexmill.llm.components import stars
from lexmill.llm.exchange import DOCUMENTS, SCHEMA, aligned, answered, gathered, questions, rows_of, tasks_for, together
from lexmill.llm.storage import written
from lexmill.llm.xxh64 import xxh64

BITS = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Shingles whose bits are added up in 16-bit lanes at a time.
_SEGMENT = 32768
#: Buckets of up to so many rows are compared side by side with others.
SMALL = 48
#: Seconds of a row that is dealt out, and of a pair that is compared.
ROW_COST, PAIR_COST = 4e-6, 1e-8


def fingerprints_of(text: pa.Array, shingle: int, seed: int) -> np.ndarray:
    """A fingerprint for each text: the bits that over half the shingles' XXH64 have."""
    buf, offsets = text_buffers(text)
    s, e, _ = words(buf, offsets[:-1], lower_table())
    n = len(text)
    out = np.zeros(n, np.uint64)
    if not len(s):
        return out
    doc = np.searchsorted(offsets, s, side="right") - 1
    size = e - s
    start = np.cumsum(size + 1) - size - 1
    end = start + size
    joined = np.full(int(end[-1]) + 1, 32, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[end] = False
    within = np.zeros(len(buf) + 1, np.int8)
    np.add.at(within, s, 1)
    np.add.at(within, e, -1)
    joined[inside] = _LOWER[buf[np.cumsum(within[:-1], dtype=np.int8).astype(bool)]]
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    last_of = np.arange(len(s)) + shingle - 1
    whole = np.flatnonzero(last_of < (first + count)[doc])
    short = np.flatnonzero((count > 0) & (count < shingle))
    at = np.concatenate([whole, first[short]])
    to = np.concatenate([last_of[whole], first[short] + count[short] - 1])
    order = np.argsort(at, kind="stable")
    at, to = at[order], to[order]
    h = xxh64(joined, start[at], end[to], seed)
    of = doc[at]
    begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    number = np.diff(np.append(begins, len(of)))
    cuts = np.unique(np.concatenate([begins, *[np.arange(b, b + k, _SEGMENT) for b, k in zip(begins[number > _SEGMENT].tolist(), number[number > _SEGMENT].tolist())]]))
    rows = np.searchsorted(cuts, begins)
    bits = np.zeros(len(begins), np.uint64)
    lane = np.uint64(0x0001000100010001)
    for k in range(16):
        sums = np.add.reduceat((h >> np.uint64(k)) & lane, cuts).view("<u2").reshape(-1, 4).astype(np.int64)
        over = np.add.reduceat(sums, rows, axis=0) * 2 > number[:, None]
        for j in range(4):
            bits |= over[:, j].astype(np.uint64) << np.uint64(k + 16 * j)
    out[of[begins]] = bits
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash) for each row of docs; null text counts as empty, and a text without words has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for batch in slices(batches, "t", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(fingerprints_of(batch.column("t"), shingle, seed).view(np.int64)), batch.column("h")], ["doc_id", "fp", "text_hash"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as k", f"`{text_col}` as t", f"xxhash64(coalesce(`{text_col}`, '')) as h").mapInArrow(run, "doc_id long, fp long, text_hash long")


def correlated_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m groups of about equal size: each bit joins the group, with room, that it correlates with most."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    spread = bits - bits.mean(0) if len(sample) else np.zeros((1, BITS))
    norm = np.sqrt((spread**2).sum(0)) + 1e-12
    corr = np.abs(spread.T @ spread / norm[:, None] / norm)
    room = [BITS // m + (i < BITS % m) for i in range(m)]
    groups: list[list[int]] = [[] for _ in range(m)]
    left = list(range(BITS))
    for g in range(m):
        groups[g].append(left.pop(0))
        while len(groups[g]) < room[g]:
            best = int(np.argmax(corr[np.ix_(left, groups[g])].mean(1)))
            groups[g].append(left.pop(best))
    return groups


def plan(sample: np.ndarray, total: int, limit: int) -> list[tuple[list[int], int]]:
    """Groups of bits and their thresholds, at the least estimated cost for `total` distinct fingerprints."""
    i, j = np.triu_indices(len(sample), 1)
    xor = sample[i] ^ sample[j]
    best: tuple[float, list] = (np.inf, [])
    for m in range(1, limit + 2):
        groups = correlated_groups(sample, m)
        left = limit - m + 1
        cost = np.zeros((m, left + m + 1))  # of group g at threshold t, at [g, t + 1]
        for g, bits in enumerate(groups):
            mask = np.uint64(sum(1 << b for b in bits))
            near = np.bitwise_count(xor & mask)
            for t in range(left + m):
                even = sum(comb(len(bits), k) for k in range(t + 1)) / 2 ** len(bits)
                share = max(even, float((near <= t).mean()) if len(near) else 0)
                rows = 1 + sum(comb(len(bits), k) for k in range(1, t + 1)) / 2
                cost[g, t + 1] = total * rows * ROW_COST + total * total / 2 * share * PAIR_COST
        # least[r] : cost and thresholds of the groups so far, whose thresholds add up to r - (groups so far)
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in range(m):
            now: dict[int, tuple[float, list[int]]] = {}
            for r, (c, chosen) in least.items():
                for t in range(-1, left + m):
                    key = r + t + 1
                    if key <= left + m and (key not in now or c + cost[g, t + 1] < now[key][0]):
                        now[key] = (c + cost[g, t + 1], [*chosen, t])
            least = now
        c, chosen = least[left + m]
        if c < best[0]:
            best = (c, list(zip(groups, chosen)))
    return best[1]


def least_labels(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node of its component, by edges between x and y."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and least node of its component, for each node of the edges that isn't the least."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = least_labels(both[: len(a)], both[len(a) :], len(nodes))
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def nearest_forest(a: np.ndarray, b: np.ndarray, distance: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of least distances (by default, of differing bits): any two linked nodes are joined by steps no longer than their own."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    distance = np.bitwise_count(a ^ b) if distance is None else distance
    label = np.arange(len(nodes))
    kept = [np.zeros(0, np.int64)]
    for d in np.unique(distance):
        e = np.flatnonzero(distance == d)
        while len(e):
            across = label[x[e]] != label[y[e]]
            e = e[across]
            if not len(e):
                break
            number = np.arange(len(e))
            first = np.full(len(nodes), len(e))  # each component takes its first edge
            np.minimum.at(first, label[x[e]], number)
            np.minimum.at(first, label[y[e]], number)
            chosen = e[np.unique(first[first < len(e)])]
            kept.append(chosen)
            label = least_labels(label[x[chosen]], label[y[chosen]], len(nodes))[label]
    at = np.concatenate(kept)
    return a[at], b[at]


#: Longs of a set's parity bits, and their columns: bit i is set if an odd number of the set's hashes fall on it.
PARITY = 8
_PARITY = [f"p{i}" for i in range(PARITY)]


def parity_of(values: np.ndarray) -> np.ndarray:
    """Sets whose parity bits differ in d places differ in d members at least: which rules pairs out without the sets."""
    odd = np.bincount((values % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def links(fps: DataFrame, limit: int, bucket_rows: int = 16384, nearest_first: bool = False, at_least: float = 0.0, met: DataFrame | None = None, apart: tuple[int, int] | None = None) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints within `limit` bits: a spanning forest a bucket and task.

    A value that more than bucket_rows fingerprints share is dealt out as pairs of chunks, so that no task
    holds more of it than two chunks; no pair is lost. nearest_first: edges are pairs within the limit, and
    the forests those of least distances. With a column `node` beside `fp`, edges join nodes, of which several may
    have one fingerprint. With a column `label` too, the edges are all pairs of nodes within the limit whose
    labels differ, a the lesser, instead of a forest. With columns `n` and PARITY of the nodes' sets, pairs whose sets
    can't be alike by at_least (Jaccard) are left out. With met, the buckets (v) of each node, nodes meet in those
    instead of in buckets of bits; a pair may then come from several. With apart, of the pairs of a bucket whose labels
    differ those are given whose places, in the order of nodes, are apart[0] or more and fewer than apart[1] apart.
    """
    every = "label" in fps.columns
    more = [c for c in ("node", "label", "n", *_PARITY) if c in fps.columns]
    at = {c: 6 + i for i, c in enumerate(more)}
    groups = []
    if met is None:
        sample = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(2048).collect()], np.int64).view(np.uint64)  # for estimates only
        groups = [(g, bits, t) for g, (bits, t) in enumerate(plan(sample, fps.count(), limit)) if t >= 0]

    masks = [np.uint64(sum(1 << b for b in bits)) for _, bits, _ in groups]
    place = {g: i for i, (g, _, _) in enumerate(groups)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("fp").to_numpy().view(np.uint64)
            carried = [batch.column(c).to_numpy() for c in more]
            for g, bits, t in groups:
                value = x & np.uint64(sum(1 << b for b in bits))
                yield row(g, value, x, True, carried)
                for k in range(1, t + 1):
                    for flipped in combinations(bits, k):
                        other = value ^ np.uint64(sum(1 << b for b in flipped))
                        up = other > value
                        yield row(g, other[up], x[up], False, [c[up] for c in carried])

    def row(g, value, x, own, carried):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), g, np.int32)), pa.array(value.view(np.int64)), pa.array(x.view(np.int64)), pa.array(np.full(len(x), own)), *map(pa.array, carried)], ["g", "v", "fp", "own", *more])

    if met is None:
        dealt = fps.select("fp", *more).mapInArrow(deal, "g int, v long, fp long, own boolean" + "".join(f", {c} long" for c in more))
    else:
        dealt = fps.join(met, "node").select(F.lit(0).alias("g"), "v", "fp", F.lit(True).alias("own"), *more)
    large = dealt.where("own").groupBy("g", "v").count().where(F.col("count") > bucket_rows)
    chunks = F.coalesce(F.ceil(F.col("count") / bucket_rows), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("node" if more else "fp"), F.col("chunks")).cast("int")
    cells = (
        dealt.join(large, ["g", "v"], "left")
        .withColumn("chunks", chunks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("g", "v", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "fp", "own", *more)
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("g", "v", "x", "y", "fp", "own", *more)])
            held = now if held is None else np.concatenate([held, now], 1)
            new = np.flatnonzero((held[:4, 1:] != held[:4, :-1]).any(0)) + 1
            if len(new):
                yield from edges(held[:, : new[-1]])
                held = held[:, new[-1] :]
        if held is not None and held.shape[1]:
            yield from edges(held)

    def edges(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp, own = np.ascontiguousarray(rows[4]).view(np.uint64), rows[5].astype(bool)
        starts = np.append(0, np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(0)) + 1)
        size = np.diff(np.append(starts, len(fp)))
        end = np.repeat(starts + size, size)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # places of both ends
        held = 0
        if apart:
            label, here = rows[at["label"]], np.arange(len(fp))
            for d in range(apart[0], min(apart[1], int(size.max()))):
                here = here[here + d < end[here]]
                hit = here[label[here] != label[here + d]]
                hit = hit[np.bitwise_count(fp[hit] ^ fp[hit + d]) <= limit]
                found.append(wanted(rows, hit, hit + d))
                held += len(found[-1][0])
                if held > 1 << 21:
                    yield batch_of(rows, found)
                    found, held = [], 0
            yield batch_of(rows, found)
            return
        near = np.flatnonzero(np.repeat(size <= SMALL, size))
        for d in range(1, int(size[size <= SMALL].max(initial=0))):
            near = near[near + d < end[near]]
            hit = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= limit]
            found.append(wanted(rows, hit, hit + d))
            held += len(found[-1][0])
            if every and held > 1 << 21:
                yield batch_of(rows, found)
                found, held = [], 0
        held = 0
        for s, k in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist()):
            part = fp[s : s + k]
            mine = s + np.flatnonzero(own[s : s + k])  # two probes that are alike also meet in a bucket of one's own
            step = max(1, (1 << 20) // k)
            for i in range(0, len(mine), step):
                x, y = np.nonzero(np.bitwise_count(fp[mine[i : i + step], None] ^ part) <= limit)
                found.append(wanted(rows, mine[i + x], s + y))
                held += len(found[-1][0])
                if held > 1 << 21:
                    if every:
                        yield batch_of(rows, found)
                        found, held = [], 0
                    else:  # a crowd of copies: only a spanning forest of it is kept
                        found, held = [spanning(rows, found)], 0
        yield batch_of(rows, found)

    def wanted(rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of places those of two nodes; where every pair counts, each from one bucket only, as long as values aren't dealt out in chunks."""
        node = rows[6 if more else 4]
        keep = node[x] != node[y]
        if "n" in at:
            x, y = x[keep], y[keep]
            n, m = rows[at["n"], x], rows[at["n"], y]
            apart = sum(np.bitwise_count((rows[at[c], x] ^ rows[at[c], y]).view(np.uint64)).astype(np.int64) for c in _PARITY)
            keep = (np.minimum(n, m) >= at_least * np.maximum(n, m) - 1e-6) & (apart <= (1 - at_least) / (1 + at_least) * (n + m) + 1e-6)
        if every:
            keep &= (rows[at["label"], x] != rows[at["label"], y]) & ((rows[5, x] | rows[5, y]) != 0)
            x, y = x[keep], y[keep]
            apart = (rows[4, x] ^ rows[4, y]).view(np.uint64)
            own_group = np.array([place.get(g, 0) for g in rows[0, x].tolist()], np.int64)
            keep = np.ones(len(x), bool)
            for i, (mask, (_, _, t)) in enumerate(zip(masks, groups)):
                keep &= (own_group <= i) | (np.bitwise_count(apart & mask) > t)
        return x[keep], y[keep]

    def spanning(rows: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The places of a spanning forest's edges."""
        x, y = (np.concatenate([f[i] for f in found] + [np.zeros(0, np.int64)]) for i in (0, 1))
        node = rows[6 if more else 4]
        names, first = np.unique(node, return_index=True)
        if nearest_first:
            a, b = nearest_forest(node[x], node[y], np.bitwise_count((rows[4, x] ^ rows[4, y]).view(np.uint64)))
        else:
            a, b = forest(node[x], node[y])
        return first[np.searchsorted(names, a)], first[np.searchsorted(names, b)]

    def batch_of(rows: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        x, y = (np.concatenate([f[i] for f in found] + [np.zeros(0, np.int64)]) for i in (0, 1)) if every else spanning(rows, found)
        a, b = rows[6 if more else 4, x], rows[6 if more else 4, y]
        a, b = np.minimum(a, b), np.maximum(a, b)
        if not groups:  # several buckets of a batch may have the same pair
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
            a, b = a[new], b[new]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    within = ["node"] if apart else []
    return cells.repartition("g", "v", "x", "y").sortWithinPartitions("g", "v", "x", "y", *within).mapInArrow(compare, "a long, b long")


def shingle_sets(text: pa.Array, shingle: int) -> list[np.ndarray]:
    """The distinct hashed shingles of each text, in order; a text of fewer words is one shingle, one of none has none."""
    buf, offsets = text_buffers(text)
    s, _, h = words(buf, offsets[:-1], lower_table())
    count = np.bincount(np.searchsorted(offsets, s, side="right") - 1, minlength=len(text))
    out = []
    for first, n in zip((np.cumsum(count) - count).tolist(), count.tolist()):
        at = first + np.arange(max(n - shingle + 1, min(n, 1)))
        out.append(np.unique(chained(h, at, np.minimum(shingle, first + n - at))))
    return out


#: A head is longer by this share of its set than it must be for one common member.
LONGER = 0.1


def head_of(values: np.ndarray, at_least: float) -> np.ndarray:
    """The first members of a set in one order of all hashes (by `mix`).

    Alike sets of n and m members have at least_of_head(n), at_least_of_head(m) and more common members in both heads: the
    j-th common one, of at least at_least * n, has place n - at_least * n + j at most.
    """
    n = len(values)
    return values[np.argsort(mix(values))[: n - int(np.ceil(at_least * n - 1e-6)) + 1 + int(LONGER * n)]]


def at_least_of_head(n: np.ndarray, at_least: float) -> np.ndarray:
    """How many members of the head, at least, a set of n members shares with the head of any that is alike, which may be smaller."""
    return 1 + np.maximum(0, np.floor(LONGER * at_least * n - 1e-6)).astype(np.int64)


def described(docs: DataFrame, shingle: int, compared_shingle: int, seed: int, id_col: str, text_col: str, at_least: float) -> DataFrame:
    """(doc_id, fp, node, text_hash, n, parity, head) for each row of docs: the node is the hash of the set of its shingles of compared_shingle words, n their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for batch in slices(batches, "t", 1 << 20):
            fp = pa.array(fingerprints_of(batch.column("t"), shingle, seed).view(np.int64))
            sets = shingle_sets(batch.column("t"), compared_shingle)
            end = np.cumsum([8 * len(x) for x in sets], dtype=np.int64)
            start = end - np.array([8 * len(x) for x in sets], np.int64)
            node = xxh64(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.uint8), start, end, seed)
            parity = np.stack([parity_of(x) for x in sets])
            columns = [batch.column("k"), fp, pa.array(node.view(np.int64)), batch.column("h"), pa.array([len(x) for x in sets], pa.int64()), *[pa.array(parity[:, i]) for i in range(PARITY)], pa.array([head_of(x, at_least).tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "node", "text_hash", "n", *_PARITY, "head"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as k", f"`{text_col}` as t", f"xxhash64(coalesce(`{text_col}`, '')) as h").mapInArrow(run, "doc_id long, fp long, node long, text_hash long, n long" + "".join(f", {c} long" for c in _PARITY) + ", head binary")


def batches_of(sets: DataFrame, most_bytes: int = 4 << 20) -> DataFrame:
    """Rows (node, n, members) as the exchange's batches; write the result once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("exchange")
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = np.cumsum(8 * batch.column("n").to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes, side="right")))
                part = batch.slice(at, to - at)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield rows_of([number], [DOCUMENTS], [0], [part.num_rows], [part.nbytes], [sink.getvalue().to_pybytes()])
                number, at = number + 1, to

    return sets.select("node", F.col("n").cast("long").alias("n"), "members").mapInArrow(run, SCHEMA)


def _members(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All members of a batch's sets, and the place of each one's set."""
    held = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("members")]
    return np.concatenate([*held, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(held)), [len(x) for x in held])


#: Bits of an answer for the sum of the nodes' hashes; those above are the number of nodes, so that answers sort by it.
_SUM_BITS = 40


def _nodes_that_share(keys: np.ndarray, values: list, part: np.ndarray):
    """For each member how many nodes have it, and a hash of which: members of the same nodes get the same answer."""
    order, new = exchange.groups(keys)
    first = np.flatnonzero(new)
    number = np.minimum(np.add.reduceat(values[0][order].astype(np.int64), first), (1 << 23) - 1).astype(np.uint64)
    which = np.add.reduceat(values[1][order], first) & np.uint64((1 << _SUM_BITS) - 1)
    which[number == 1] = 0
    out = np.empty(len(keys), np.uint64)
    out[order] = np.repeat(number << np.uint64(_SUM_BITS) | which, np.diff(np.append(first, len(order))))
    return out, None


def _in_several_nodes(keys: np.ndarray, values: list, part: np.ndarray):
    order, new = exchange.groups(keys)
    first = np.flatnonzero(new)
    out = np.empty(len(keys), np.uint8)
    out[order] = np.repeat(np.add.reduceat(values[0][order].astype(np.int64), first) > 1, np.diff(np.append(first, len(order))))
    return out, None


def sets_that_may_meet(rows: DataFrame, at_least: float, tasks: int) -> DataFrame:
    """The nodes whose heads share as much with other heads as those of alike sets do."""
    heads = written(batches_of(rows.where("n > 0").select("node", "n", F.col("head").alias("members")).dropDuplicates(["node"])), "heads")

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, part, _ in gathered(parts):
            keys, count = np.unique(_members(part)[0], return_counts=True)
            yield questions(b, 4 * tasks, keys, count.astype(np.uint32))

    met = written(answered(heads.mapInArrow(ask, heads.schema), [np.uint32], _in_several_nodes, 1, tasks), "met-heads")

    def pick(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, answers in gathered(parts):
            members, of = _members(part)
            several = aligned(answers, 1, np.uint8)[np.unique(members, return_inverse=True)[1]]
            shared = np.bincount(of, several, part.num_rows)
            yield part.select(["node"]).filter(pa.array(shared >= at_least_of_head(part.column("n").to_numpy(), at_least)))

    return written(together(heads, met).mapInArrow(pick, "node long"), "may-meet")


def meetings(known: DataFrame, at_least: float, tasks: int) -> DataFrame:
    """Buckets (node, v) in which any two alike sets of known (node, n, set) meet.

    Of two alike sets the rarest members, as many as may be missing and one more, have one in common. Members of the same
    sets share a bucket, and members of one set have none.
    """
    sets = written(batches_of(known.where("n > 0").withColumnRenamed("set", "members")), "sets")

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, part, _ in gathered(parts):
            members, of = _members(part)
            keys, which, count = np.unique(members, return_inverse=True, return_counts=True)
            order = np.argsort(which, kind="stable")
            sums = np.add.reduceat(mix(part.column("node").to_numpy().view(np.uint64))[of[order]], np.cumsum(count) - count)
            yield questions(b, 4 * tasks, keys, count.astype(np.uint32), sums)

    shares = written(answered(sets.mapInArrow(ask, sets.schema), [np.uint32, np.uint64], _nodes_that_share, 1, tasks), "shares")

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, answers in gathered(parts):
            members, of = _members(part)
            share = aligned(answers, 1, np.uint64)[np.unique(members, return_inverse=True)[1]]
            order = np.lexsort((members, share, of))  # `of` is in order, so that places within a set follow
            n = np.bincount(of, minlength=part.num_rows)
            place = np.arange(len(of)) - (np.cumsum(n) - n)[of]
            chosen = order[(place < (n - np.ceil(at_least * n - 1e-6) + 1)[of]) & (share[order] >> np.uint64(_SUM_BITS) > 1)]
            dealt = np.unique(np.stack([of[chosen].astype(np.uint64), share[chosen]]), axis=1)
            node = part.column("node").to_numpy()[dealt[0].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(dealt[1].view(np.int64))], ["node", "v"])

    return written(together(sets, shares).mapInArrow(deal, "node long, v long"), "meetings")


def sets_of(docs: DataFrame, rows: DataFrame, involved: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(node, n, set) of the nodes involved."""
    # one row stands for a node: that of least id, or of no id if there is no other
    shown = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", "text_hash").alias("place"), "text_hash")).alias("m")).select("node", "m.place", "m.text_hash")
    shown = involved.join(shown, "node")
    texts = docs.selectExpr(f"coalesce(cast(`{id_col}` as long), xxhash64(coalesce(`{text_col}`, ''))) as place", f"xxhash64(coalesce(`{text_col}`, '')) as text_hash", f"`{text_col}` as t").join(shown, ["place", "text_hash"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 20):
            found = shingle_sets(batch.column("t"), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(f) for f in found], pa.int32()), pa.array([f.tobytes() for f in found], pa.binary())], ["node", "n", "set"])

    return written(texts.select("node", "t").mapInArrow(sets, "node long, n int, set binary").dropDuplicates(["node"]), "shingle-sets")


def alike(known: DataFrame, edges: DataFrame, at_least: float) -> DataFrame:
    """The edges (a, b) whose nodes' sets in known (node, n, set) share so much at least (Jaccard)."""
    side = lambda c, n, *more: known.select(F.col("node").alias(c), *[F.col(m).alias(n) for m in more])
    # sets of too different sizes can't be alike
    sized = edges.join(side("a", "n", "n"), "a").join(side("b", "m", "n"), "b").where(F.least("n", "m") >= at_least * F.greatest("n", "m") - 1e-6)
    pairs = sized.select("a", "b").join(side("a", "x", "set"), "a").join(side("b", "y", "set"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= at_least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


#: Each round compares places up to so many times as far apart as the round before.
REACH = 16


def joined_by_rounds(nodes: DataFrame, known: DataFrame, met: DataFrame, tried: DataFrame, joined: DataFrame, limit: int, bucket_rows: int, at_least: float) -> DataFrame:
    """(a, b) for each node a that isn't the least of its component, b being that least node; joined are the alike ones of the edges tried.

    Every pair of a bucket's nodes has its round, by how far apart they stand in the bucket, and is compared in it unless
    they are joined by then; so no link is lost. Nodes stand by their hashes, so that a round is a random share of a
    crowd's pairs: once it has joined most of the crowd, the many pairs of the next rounds needn't be looked at. A bucket
    whose nodes are all joined is left out of what follows.
    """
    reach = 1
    while True:
        star = stars(joined, "alike-links")
        label = star.select(F.col("a").alias("node"), F.col("b").alias("label"))
        several = met.join(label, "node", "left").select("v", F.coalesce("label", "node").alias("label")).groupBy("v").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("rows")).where("x < y")
        several = written(several.select("v", "rows"), "open-buckets")
        if (several.agg(F.max("rows").alias("rows")).first().rows or 0) <= reach:
            return star
        met = met.join(several, "v", "left_semi")
        labelled = nodes.join(label, "node", "left").select("fp", "node", F.coalesce("label", "node").alias("label"), "n", *_PARITY)
        pairs = written(links(labelled, limit, bucket_rows, at_least=at_least, met=met, apart=(reach, REACH * reach)).distinct(), "other-pairs")
        joined = star.unionByName(alike(known, pairs.join(tried, ["a", "b"], "left_anti"), at_least))
        tried, reach = tried.unionByName(pairs), REACH * reach


def near_duplicates(docs: DataFrame, limit: int = 3, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 16384,
                    at_least: float | None = None, compared_shingle: int = 5, with_kept: bool = False) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), and component_id, the least doc_id reachable.

    Fingerprints link at `limit` or fewer differing bits. With at_least, a link counts only if the texts'
    shingles of compared_shingle words are alike by so much (Jaccard). Such texts share one of their rarest shingles, and
    are looked for among those that do. First the links of spanning forests of least
    distances are compared, which joins crowds of copies at a linear number of comparisons; then, in rounds, every link
    between texts that aren't joined by its round, so none is lost. Texts of equal shingle sets are alike; texts of
    one fingerprint are compared like any others. A to Z are lower-cased; words are
    `[^\\x20\\x09-\\x0D]+`; a text of fewer words than a shingle is one shingle, and one without words (or
    null) has fingerprint 0, linked like any other. A null id is reached but never the least unless no row
    of the component has an id. Repeated rows are in the same component; an empty table gives an empty
    result. with_kept adds text_hash, the xxhash64 of the text ('' for null), and kept: whether the row has the id and
    text_hash of the component's least (one id may come with several texts, in several components).
    """
    if at_least is None:
        rows = written(fingerprints(docs, shingle, seed, id_col, text_col).withColumn("node", F.col("fp")), "fingerprints")
        edges = links(rows.select("fp").distinct(), limit, bucket_rows)
    else:
        rows = written(described(docs, shingle, compared_shingle, seed, id_col, text_col, at_least), "fingerprints")
        nodes = written(rows.select("fp", "node", "n", *_PARITY).distinct(), "distinct-fingerprints")
        tasks = tasks_for(docs)
        known = sets_of(docs, rows, sets_that_may_meet(rows, at_least, tasks), compared_shingle, id_col, text_col)
        met = meetings(known, at_least, tasks)
        tried = written(links(nodes, limit, bucket_rows, nearest_first=True, at_least=at_least, met=met).distinct(), "fingerprint-pairs")
        joined = written(alike(known, tried, at_least), "alike")
        edges = joined_by_rounds(nodes, known, met, tried, joined, limit, bucket_rows, at_least)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = written(rows.groupBy("node").agg(F.min(row).alias("least"), F.count("*").alias("n")), "distinct-nodes")
    star = stars(edges, "fingerprint-links")
    member = star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    member = member.join(nodes, "node")
    component = member.join(member.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    known = written(nodes.join(component, "node", "left").select("node", "n", F.coalesce("component", "least").alias("component")), "known-nodes")
    # nodes of over a thousandth of all rows, fewer than a thousand, don't go by a shuffle, where each would be one task
    share = known.agg(F.sum("n").alias("n")).first().n or 0
    hot = F.broadcast(known.where(F.col("n") > share / 1000).drop("n"))
    out = rows.join(hot, "node").unionByName(rows.join(hot, "node", "left_anti").join(known.drop("n"), "node"))
    columns = ["doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component.doc_id").alias("component_id")]
    if with_kept:
        columns += ["text_hash", (F.col("doc_id").eqNullSafe(F.col("component.doc_id")) & (F.col("text_hash") == F.col("component.text_hash"))).alias("kept")]
    return out.select(*columns)
