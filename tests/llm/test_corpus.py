"""Language-model scores, substring dedup, SimHash and BM25 against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import bm25, ngram, simhash, substring
from lexmill.llm.arrow_text import chained, lower_table, plain_table, words
from lexmill.llm.components import stars
from lexmill.llm.xxh64 import xxh64

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def plain(t):
    return WORD.findall((t or "").encode())


def lowered(t):
    return [w.translate(LOWER) for w in plain(t)]


@given(st.lists(st.text("aA \n é\x00", max_size=20), min_size=1, max_size=5))
def test_words(parts):
    data = [p.encode() for p in parts]
    buf = np.frombuffer(b"".join(data), np.uint8)
    starts = np.cumsum([0, *map(len, data)])[:-1]
    s, e, h = words(buf, starts, plain_table())
    want = [w for d in data for w in WORD.findall(d)]
    assert [buf[a:b].tobytes() for a, b in zip(s, e)] == want
    same = {}
    assert all(same.setdefault(w, x) == x for w, x in zip(want, h.tolist())) and len(set(h.tolist())) == len(set(want))
    low = words(buf, starts, lower_table())[2]
    assert len(set(low.tolist())) == len({w.translate(LOWER) for w in want})


def alternating(n):
    """n bytes and their complement: sums over powers of an odd base can't tell them apart where n is a power of two from 1024 on."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_of_alternating_parity():
    data = [x.encode() for n in (64, 1024, 2048, 4096) for x in alternating(n)]
    buf = np.frombuffer(b" ".join(data), np.uint8)
    assert len(set(words(buf, np.array([0]), plain_table())[2].tolist())) == len(data)
    assert words(buf, np.array([0]), plain_table())[2].tolist() == [xxhash.xxh64_intdigest(d, 0) for d in data]
    pair = np.array([3, 17], np.uint64)
    rows = np.stack([pair[[i.bit_count() % 2 for i in range(4096)]], pair[[1 - i.bit_count() % 2 for i in range(4096)]]])
    assert len(np.unique(chained(rows.ravel(), np.array([0, 4096]), 4096))) == 2


def test_long_words_that_occur_once_stay(spark):
    common = " ".join(f"w{i}" for i in range(19))
    a, b = alternating(2048)
    df = spark.createDataFrame([(1, f"{common} {a}"), (2, f"{common} {b}"), (3, f"{common} {a}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 20}
    # held out: document 2 knows neither word that it alone has
    k = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    df = spark.createDataFrame([(1 if zlib.crc32(b"1") % 10 else 3, a), (k, b)], "doc_id long, text string")
    assert {r.doc_id == k: r.n_known for r in ngram.score_texts(df).collect()} == {False: 2, True: 1}


def test_very_long_texts(spark):
    """One of a million words, one of a word of three million letters, beside small ones."""
    many = " ".join(f"w{i % 50000}x{i // 50000}" for i in range(400_000))
    rows = [(10, many), (11, "y" * 3_000_000), (12, " ".join(many.split(" ")[1000:1100])), (13, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in substring.remove_repeats(df).collect()}
    assert (got[10].n_words, got[10].n_removed, got[11].n_words, got[12].n_removed, got[13].n_words) == (400_000, 0, 1, 100, 0)
    assert {r.doc_id: r.n_tokens for r in ngram.score_texts(df).collect()} == {10: 400_001, 11: 2, 12: 101, 13: 1}
    assert {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(df).collect()} == {k: fingerprint(t) for k, t in rows}


def training(texts):
    return {i: (k is not None and zlib.crc32(str(k).encode()) % 10 != 0) for i, (k, _) in enumerate(texts)}


def test_scores(docs, none, texts):
    train = training(texts)
    tokens = [[*lowered(t), None] for _, t in texts]
    c = Counter(w for i, w_s in enumerate(tokens) for w in w_s if train[i])
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for i, w_s in enumerate(tokens) for p in zip(["start", *w_s], w_s) if train[i])
    starts = sum(train.values())
    rows = ngram.score_texts(docs, batch_bytes=4000).collect()
    assert len(rows) == len(texts)
    want = {}
    for i, (k, t) in enumerate(texts):
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i])
        want.setdefault(k, []).append((not train[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n, round(base, 6)))
    got: dict = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}
    # the model's score, with the weights that the same held-out counts teach
    cells: dict = {}
    for (a, w), k in pairs.items():
        before = starts if a == "start" else c[a]
        for cell, m in ngram.cells_of(np.array([k]), np.array([before]), np.array([c[w]]), n):
            cells[cell] = cells.get(cell, 0) + m
    learnt = ngram.Weights.learn(cells, v).table
    assert np.allclose(learnt.sum(1), 1)
    model: dict = {}
    for i, (k, t) in enumerate(texts):
        total = 0.0
        for a, w in zip(["start", *tokens[i]], tokens[i]):
            before = starts if a == "start" else c[a]
            l2, l1, l0 = learnt[int(ngram.context_bucket(np.array([before]))[0])]
            total += math.log10((l2 * pairs[a, w] / before if before else 0) + l1 * c[w] / n + l0 / (v + 1))
        model.setdefault(k, []).append(total)
    mine: dict = {}
    for r in rows:
        mine.setdefault(r.doc_id, []).append(r.score)
    for k in model:  # counts travel by eighths of an octave for the weights only
        assert sorted(mine[k]) == pytest.approx(sorted(model[k]), rel=0.02)
    held = [r for r in rows if r.held_out and r.n_tokens > 20]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert ngram.score_texts(none).count() == 0


def test_scores_without_training(spark):
    k = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = ngram.score_texts(spark.createDataFrame([(k, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and math.isfinite(r.score)


def test_probabilities_of_a_context_add_up():
    learnt = ngram.Weights.learn({int(ngram.estimate_cell(np.array([3]), np.array([0.25]), np.array([0.01]))[0]): 5}, 100).table
    l2, l1, l0 = learnt[3]
    f2, f1 = [0.5, 0.5] + [0] * 98, [0.01] * 100
    assert sum(l2 * a + l1 * b + l0 / 101 for a, b in zip(f2, f1)) + l0 / 101 == pytest.approx(1)


def removed(texts, window):
    order = [(-(2**63) if k is None else k) for k, _ in texts]
    tokens = [plain(t) for _, t in texts]
    first: dict = {}
    for k, w in zip(order, tokens):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (k, i)), (k, i))
    out = []
    for k, w in zip(order, tokens):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (k, i):
                gone[i : i + window] = [True] * window
        out.append(gone)
    return tokens, out


@pytest.mark.parametrize("batch_bytes", [500, 4 << 20])
def test_substrings(docs, none, texts, batch_bytes):
    tokens, gone = removed(texts, 20)
    want: dict = {}
    for (k, t), w, g in zip(texts, tokens, gone):
        kept = [x for x, y in zip(w, g) if not y]
        want.setdefault(k, []).append((len(w), sum(g), hashlib.sha256(b" ".join(kept)).hexdigest(), kept, (t or "") if not any(g) else None))
    rows = substring.remove_repeats(docs, with_text=True, carry=["lang", "k"], batch_bytes=batch_bytes).collect()
    assert len(rows) == len(texts) and sum(sum(g) for g in gone) > 200
    for r in rows:
        assert (r.n_words, r.n_removed, r.kept_sha256) in [w[:3] for w in want[r.doc_id]]
        assert (plain(r.kept_text), r.kept_text if not r.n_removed else None) in [w[3:] for w in want[r.doc_id]]
        assert (r.lang, r.k) == ("en", 1)
    assert substring.remove_repeats(none).count() == 0


def test_difference_cover():
    p, d = substring.PERIOD, substring.COVER
    assert all(any((i + s) % p in d and (j + s) % p in d for s in range(p)) for i in range(p) for j in range(p))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 120)), min_size=1, max_size=30), st.integers(0, 2**64 - 1))
def test_xxh64(spans, seed):
    buf = np.random.default_rng(3).integers(0, 256, 400, dtype=np.uint8)
    s = np.array([a for a, _ in spans])
    e = s + np.array([b for _, b in spans])
    assert xxh64(buf, s, e, seed).tolist() == [xxhash.xxh64_intdigest(buf[a:b].tobytes(), seed) for a, b in zip(s, e)]


def fingerprint(t, shingle=3):
    w = lowered(t)
    if not w:
        return 0
    sh = [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def components(fps, limit):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("limit,bucket_rows", [(3, 16384), (3, 2), (9, 16384), (9, 3)])
def test_simhash(docs, none, texts, limit, bucket_rows):
    fps = [fingerprint(t) for _, t in texts]
    comp = components(fps, limit)
    least: dict = {}
    for c, (k, _) in zip(comp, texts):
        if k is not None:
            least[c] = min(least.get(c, k), k)
    want = sorted((k if k is not None else -1, format(f, "016x"), least.get(c)) for (k, _), f, c in zip(texts, fps, comp))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, limit=limit, bucket_rows=bucket_rows).collect())
    assert got == want
    assert simhash.near_duplicates(none).count() == 0


def test_crowded_fingerprints(spark):
    """A crowd around one fingerprint, and the rest at random, dealt out in chunks or not."""
    rng = np.random.default_rng(8)
    crowd = [0xABCDEF0123456789 ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(300)]
    fps = sorted({*crowd, *(int(x) for x in rng.integers(0, 2**63, 300))})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long").repartition(4)
    want = components(fps, 3)
    for rows in (16384, 50):
        star = {r.a: r.b for r in stars(simhash.links(df, 3, rows)).collect()}
        got = [star.get(x, x) for x in np.array(fps, np.uint64).astype(np.int64).tolist()]
        assert len({(a, b) for a, b in zip(want, got)}) == len(set(want)) == len(set(got))


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=40))
def test_nearest_forest(pairs):
    """As many edges as any spanning forest, of the same total distance as Kruskal's."""
    points = np.random.default_rng(4).integers(0, 16, 10).astype(np.uint64)
    pairs = [(int(points[i]), int(points[j])) for i, j in pairs if points[i] != points[j]]
    a, b = (np.array([p[i] for p in pairs], np.uint64) for i in (0, 1))
    x, y = simhash.nearest_forest(a, b)
    root = {int(p): int(p) for p in points}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    kept = []
    for d, i, j in sorted(((p ^ q).bit_count(), p, q) for p, q in pairs):
        if find(i) != find(j):
            root[find(i)] = find(j)
            kept.append(d)
    assert sorted(np.bitwise_count(x ^ y).tolist()) == kept


def jaccard(s, t, k=5):
    def shingles(x):
        w = lowered(x)
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    a, b = shingles(s), shingles(t)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_are_compared(spark, docs, none):
    import random

    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = "".join(rng.choice("abcdefghij ") if i % 6 else " " for i in range(1500)).split()
        rows.append((10 * g, " ".join(base)))
        for v, changes in enumerate((1, 2, 12, 40)):
            w = list(base)
            for i in rng.sample(range(len(w)), changes):
                w[i] = "zz"
            rows.append((10 * g + v + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, limit=12, at_least=0.8).collect()}
    hits = 0
    for k, t in text.items():
        base = k - k % 10
        close = [j for j in text if j < k and jaccard(text[j], t) >= 0.8]
        assert (got[k] == k) or any(got[j] == got[k] for j in close)  # nothing else is linked
        hits += (got[k] != k) == bool(close)
        assert got[k] in (k, *range(base, k + 1))
    assert hits >= 0.95 * len(text)
    assert simhash.near_duplicates(none, at_least=0.8).count() == 0
    assert simhash.near_duplicates(docs, limit=12, at_least=0.8).count() == docs.count()


def detours(rng, groups):
    """Threes of texts: the first two are alike, and the third, whose passages stand in another order, is nearer to both in bits, but like neither."""
    rows = []
    while len(rows) < 3 * groups:
        w = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(198)]
        a, b = " ".join(w), " ".join([*w[:-18], *(f"z{x}" for x in w[-18:])])
        passages = [w[i : i + 18] for i in range(0, 198, 18)]
        rng.shuffle(passages)
        c = " ".join(sum(passages, []))
        ab, ac, bc = ((fingerprint(x) ^ fingerprint(y)).bit_count() for x, y in ((a, b), (a, c), (b, c)))
        if max(ac, bc) < ab <= 12 and min(ac, bc) > 0 and jaccard(a, b) >= 0.8 > max(jaccard(a, c), jaccard(b, c)):
            rows += [(len(rows) + i, s) for i, s in enumerate((a, b, c))]
    return rows


@pytest.mark.parametrize("bucket_rows", [16384, 3])
def test_every_candidate_is_compared(spark, bucket_rows):
    import random

    rows = detours(random.Random(6), 8)
    text = dict(rows)
    sets = {k: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)})(t.split()) for k, t in rows}
    fps = {k: fingerprint(t) for k, t in rows}
    root = {k: k for k in text}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in text:
        for j in text:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 12 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert len(set(fps.values())) == len(fps)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), limit=12, at_least=0.8, bucket_rows=bucket_rows).collect()}
    assert got == {k: find(k) for k in text}


def test_kept_rows(spark):
    """Of each component one id and text is kept; an id with two texts is in two components."""
    words = lambda c: " ".join(f"{c}{i}" for i in range(50))
    rows = [(1, words("a")), (2, words("a")), (2, words("b")), (2, words("c")), (2, words("c") + " d"), (3, words("b")), (None, words("a")), (None, words("e"))]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), limit=12, at_least=0.8, with_kept=True).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.component_id) for r in got if r.kept and r.doc_id) == [(1, 1), (2, 2), (2, 2)]
    assert sorted((r.doc_id, r.component_id) for r in got if not r.kept and r.doc_id) == [(2, 1), (2, 2), (3, 2)]


@given(st.sets(st.integers(0, 2**64 - 1), max_size=40), st.sets(st.integers(0, 2**64 - 1), max_size=40), st.sets(st.integers(0, 2**64 - 1), max_size=40))
def test_parity_never_exceeds_the_difference(a, b, both):
    x, y = (np.array(sorted(s | both), np.uint64) for s in (a, b))
    apart = int(np.bitwise_count((simhash.parity_of(x) ^ simhash.parity_of(y)).view(np.uint64)).sum())
    assert apart <= len((a | both) ^ (b | both))


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.lists(st.integers(0, 2**64 - 1), max_size=10), st.integers(0, 9))
def test_heads_of_alike_sets_meet(a, more, less):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, set(sorted(a)[less:]) | set(more)))
    if len(x) and len(y) and len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
        both = len(np.intersect1d(simhash.head_of(x, 0.8), simhash.head_of(y, 0.8)))
        assert both >= simhash.at_least_of_head(np.array([len(x), len(y)]), 0.8).max()


def test_only_texts_that_share_rare_shingles_are_dealt_out(spark):
    """Texts that have no more than a common passage get no bucket; before, each went to some by its bits, the more the larger the corpus."""
    import random

    rng = random.Random(11)
    passage = " ".join(rng.choices("abcdefgh", k=30))
    own = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(100)) for _ in range(200)]
    rows = [(i, f"{t} {passage}") for i, t in enumerate(own)] + [(1000 + i, f"{own[i]} {passage} more") for i in range(5)] + [(2000, own[9] + " " + passage), (3000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    described = simhash.described(df, 3, 5, 42, "doc_id", "text", 0.8)
    known = simhash.sets_of(df, described, simhash.sets_that_may_meet(described, 0.8, 4), 5, "doc_id", "text")
    met = simhash.meetings(known, 0.8, 4).join(described, "node").select("doc_id", "v").distinct().collect()
    assert {r.doc_id for r in met} == {*range(5), *range(1000, 1005)}
    assert len(met) <= 2 * 10
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, limit=12, at_least=0.8).collect()}
    assert got == {k: {2000: 9}.get(k, k - 1000 if 1000 <= k < 1005 else k) for k, _ in rows}


def test_crowds_on_the_verge_are_compared_in_rounds(spark, monkeypatch):
    """Versions of one text, of which few pairs are alike: the crowd is joined by few comparisons; before, all pairs of what the first forest left apart were compared."""
    import random

    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = []
    for i in range(240):
        w = list(base)
        for j in rng.sample(range(60), rng.choice((4, 5, 5, 5))):
            w[6 * j] = f"z{i}"
        rows.append((i, " ".join(w)))
    sets = [(lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)})(t.split()) for _, t in rows]
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 12 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    compared, alike = [], simhash.alike

    def counted(known, edges, at_least):
        compared.append(edges.count())
        return alike(known, edges, at_least)

    monkeypatch.setattr(simhash, "alike", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, limit=12, at_least=0.8).collect()}
    assert got == {k: find(k) for k, _ in rows}
    assert sum(compared) <= 30 * len(rows)


@pytest.mark.parametrize("bucket_rows", [16384, 3])
def test_equal_fingerprints_are_compared(spark, bucket_rows):
    import random

    rng = random.Random(9)
    other = [["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)] for _ in range(4)]
    rows = [(i, " ".join(["na"] * 120 + w)) for i, w in enumerate(other)]
    rows += [(10 + i, " ".join(["na"] * 130 + w)) for i, w in enumerate(other)]  # the same set of shingles
    rows += [(20 + i, " ".join(["na"] * 120 + w[:-1] + ["z"])) for i, w in enumerate(other)]
    rows += [(None, rows[0][1])]
    assert len({fingerprint(t) for _, t in rows}) == 1
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), limit=12, at_least=0.8, bucket_rows=bucket_rows).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in got) == sorted((-1 if k is None else k, (k or 0) % 10) for k, _ in rows)


@given(st.integers(0, 5), st.integers(2, 10**9))
@settings(max_examples=20, deadline=None)
def test_plan_keeps_the_pigeonhole(limit, total):
    sample = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    groups = simhash.plan(sample, total, limit)
    assert sorted(b for bits, _ in groups for b in bits) == list(range(64))
    assert sum(t for _, t in groups) == limit - len(groups) + 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    got = {r.a: r.b for r in stars(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {201: 200}


def test_bm25(docs, none, texts):
    kept = [(k, Counter(lowered(t))) for k, t in texts if k is not None]
    df = Counter(w for _, c in kept for w in c)
    n, mean = len(kept), sum(sum(c.values()) for _, c in kept) / len(kept)
    for shard_bytes in (700, 16 << 20):
        got: dict = {}
        for r in bm25.search(docs, "k % 10 = 0", k=4, shard_bytes=shard_bytes, query_block=3).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
        for q, terms in {k: c for k, c in kept if k % 10 == 0}.items():
            scores = []
            for k, c in kept:
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in terms if w in c)
                if k != q and s > 0:
                    scores.append((-round(s, 9), k))
            best = sorted(scores)[:4]
            mine = sorted(got.get(q, []))
            assert [x[0] for x in mine] == list(range(1, len(best) + 1))
            assert [x[1] for x in mine] == [k for _, k in best]
            assert [x[2] for x in mine] == pytest.approx([-s for s, _ in best], abs=1e-8)
    assert bm25.search(none, "k % 10 = 0").count() == 0


def languages(rng, n, kinds=3):
    """Texts of as many vocabularies, each with its own frequent words, and few rare words that all share."""
    for i in range(n):
        common, c = [f"{'abc'[i % kinds]}{j}" for j in range(12)], i % kinds
        yield c, " ".join([*rng.choices(common, k=20), *(f"{c}w{rng.randrange(400)}" for _ in range(15)), *(f"s{rng.randrange(200)}" for _ in range(2))])


def test_bm25_of_several_languages(spark):
    """A shard's documents are parted by their frequent words, and the result stays that of all pairs."""
    import random

    rows = list(enumerate(languages(random.Random(2), 1200)))
    batch = bm25.Batch(pa.record_batch({"k": pa.array([i for i, _ in rows]), "t": pa.array([t for _, (_, t) in rows])}))
    kind = bm25.kinds(batch)
    assert len(set(kind.tolist())) >= 3 and len({(a, c) for a, (_, (c, _)) in zip(kind.tolist(), rows)}) == len(set(kind.tolist()))
    text = {i: Counter(lowered(t)) for i, (_, t) in rows}
    df, mean = Counter(w for c in text.values() for w in c), sum(sum(c.values()) for c in text.values()) / len(text)
    got: dict = {}
    for r in bm25.search(spark.createDataFrame([(i, t) for i, (_, t) in rows], "doc_id long, text string"), "k % 50 = 0", k=5, query_block=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    for q in range(0, len(rows), 50):
        scores = sorted((-round(sum(math.log(1 + (len(text) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in text[q] if w in c), 9), k) for k, c in text.items() if k != q)
        assert [d for _, d, _ in sorted(got[q])] == [k for _, k in scores[:5]]
        assert [s for _, _, s in sorted(got[q])] == pytest.approx([-s for s, _ in scores[:5]], abs=1e-8)


def test_bm25_of_repeated_queries(spark):
    """Of the texts of a query's id the first counts; no document is listed twice but for rows that repeat it; tiny texts fill many shards."""
    rows = [(50, "a b"), (50, "a c d"), (50, "a b"), (1, "a b"), (2, "a c"), (3, "c d"), (4, "b")] + [(100 + i, "") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for shard_rows in (3, 16384):
        got = bm25.search(df, "k = 50", shard_rows=shard_rows).orderBy("rank").collect()
        assert [(r["rank"], r.doc_id) for r in got] == [(1, 1), (2, 4), (3, 2)] and got[0].score > got[1].score > got[2].score > 0
