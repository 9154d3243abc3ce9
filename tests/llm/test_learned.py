"""Classifiers by held-out accuracy, nearest neighbours by recall."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import ann, quality, toxicity
from lexmill.llm.labelled import fold, labelled_sample

SF = "/root/testdata/sf0.01"


def area(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    y = np.array(y)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("module,label,folds,out,least", [(quality, "quality", 3, 1, 0.9), (toxicity, "toxic", 5, 0, 0.8)])
def test_held_out(tables, module, label, folds, out, least):
    docs, labels = tables
    model = module.train(docs, labels, fold("k") % folds != out)
    scored = module.score(docs, model)
    rows = scored.join(labels, "doc_id").where(fold("doc_id") % folds == out).select(label, "score").collect()
    assert area([r[0] for r in rows], [r[1] for r in rows]) > least
    assert scored.count() == docs.count() and scored.where("not score between 0 and 1 or predicted <> int(score >= 0.5)").count() == 0


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, docs, none, texts, module, label):
    labels = spark.createDataFrame([(k, i % 2, i % 2) for i, k in enumerate(range(40))] + [(None, 1, 1), (1, None, None), (2, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text", "1 as y")
    for chosen in (labels, labels.where("doc_id % 2 = 0"), labels.limit(0)):  # both classes, one, none
        model = module.train(docs, chosen, F.lit(True))
        rows = module.score(docs, model).collect()
        assert len(rows) == len(texts) and all(0 <= r.score <= 1 and math.isfinite(r.score) for r in rows)
    assert module.score(none, model).count() == 0
    same = {r.doc_id: r.score for r in rows}
    assert same[0] == same[100]  # copies score alike


def test_sample_is_bounded_and_repeatable(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    first = sorted(r.k for r in labelled_sample(docs, labels, "quality", F.lit(True), 10).select("k").distinct().collect())
    assert len(first) == 10 and first == sorted(r.k for r in labelled_sample(docs, labels, "quality", F.lit(True), 10).select("k").distinct().collect())


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    fm = quality.FactorisationMachine(0.3, rng.normal(size=6), rng.normal(size=(6, 3)), np.zeros(1), np.ones(1))
    x = rng.normal(size=6)
    slow = 0.3 + fm.weight @ x + sum(fm.factor[i] @ fm.factor[j] * x[i] * x[j] for i in range(6) for j in range(i))
    assert fm.logits(np.zeros(6, int), np.arange(6), x, 1)[0] == pytest.approx(slow)


def test_counterfactual_penalty_evens_out_identity_terms():
    """Toxic texts name one group only; swapped sentences must score alike."""
    groups = (("aliens", "robots"),)
    rng = np.random.default_rng(1)
    names = [f"w{i}" for i in range(50)]
    texts, y = [], []
    for i in range(400):
        toxic = i % 4 == 0
        texts.append(" ".join([*rng.choice(names, 15), "aliens" if toxic or rng.random() < 0.1 else "robots", *(["hateful"] if toxic and rng.random() < 0.8 else [])]))
        y.append(float(toxic))
    text = pa.array(texts)
    hashes = np.unique(toxicity.word_hashes([*names, "aliens", "robots", "hateful"]))
    doc, column = toxicity.held(text, hashes)
    pairs = toxicity.swaps(text, groups)
    gap = []
    for weight in (0.0, 5.0):
        m = toxicity.fit(doc, column, np.array(y), hashes, pairs, swap_weight=weight)
        a, b = m.logits(pa.array(["some aliens here", "some robots here"]))
        gap.append(abs(a - b))
        assert m.logits(pa.array(["hateful"]))[0] > m.logits(pa.array(["plain"]))[0]
    assert gap[1] < 0.25 * gap[0]


def test_prefixes():
    text = pa.array(["unfriendlyness unfriend ab", "UNFRIENDED", ""])
    doc, h = toxicity.features(text)
    a, b = set(h[doc == 0].tolist()), set(h[doc == 1].tolist())
    assert len(a) == 3 + len(toxicity.PREFIXES) and len(b) == 1 + len(toxicity.PREFIXES)
    assert len(a & b) == len(toxicity.PREFIXES)  # unfri, unfrie, unfrien, unfriend


def test_hadamard():
    x = np.eye(8)
    assert np.allclose(ann.hadamard(x) @ ann.hadamard(x).T, np.eye(8))
    t = ann.Tables(5, 2, 1)
    v = np.random.default_rng(0).normal(size=(4, 5))
    assert np.allclose(np.linalg.norm(t.rotated(v, 1), axis=1), np.linalg.norm(v, axis=1))
    assert (t.axes(v, 0) == t.probes(v, 0, 1)[:, 0]).all()


def test_only_probed_buckets_are_compared():
    rng = np.random.default_rng(6)
    v, q = rng.normal(size=(600, 20)), rng.normal(size=(9, 20))
    tables, ids = ann.Tables(20, 5, 3), np.arange(600)
    unit, asked = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (v, q))
    candidate = np.zeros((9, 600), bool)
    for t in range(5):
        candidate |= (tables.probes(asked, t, 2)[:, :, None] == tables.axes(unit, t)).any(1)
    assert candidate.mean() < 0.3
    of, found, score = ann.nearest_in_shard(ids, v, *ann.bucket_lists(v, tables), 1000 + np.arange(9), q, tables, 2, 4)
    for i in range(9):
        near = np.where(candidate[i], unit @ asked[i], -9)
        assert found[of == 1000 + i].tolist() == np.argsort(-near)[:4].tolist() and np.allclose(score[of == 1000 + i], np.sort(near)[::-1][:4])


def test_small_tables_are_compared_in_full(spark):
    rng = np.random.default_rng(7)
    rows = [(50 * i, rng.normal(size=16).tolist()) for i in range(4)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, tables=1).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(50 * i, 50 * j) for i in range(4) for j in range(4) if i != j]


def test_mined_mentions_change_the_fit(spark):
    """On the test tables, which hold no listed term, words that fill the same places of labelled sentences are swapped."""
    from lexmill.llm.labelled import fold

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    models = [toxicity.train(docs, labels, fold("k") % 5 != 0, swap_weight=w) for w in (0.0, 1.0)]
    weights = [dict(zip(m.hashes.tolist(), m.weights.tolist())) for m in models]
    assert weights[0] != weights[1]
    sample = labels.where(fold("doc_id") % 5 != 0).where("toxic is not null").join(docs, "doc_id").selectExpr("doc_id as k", "text as t", "toxic as y")
    known = np.sort(np.array([*weights[0], *weights[1]], np.uint64))
    pairs = toxicity.interchangeable(sample, np.unique(known), 2000)
    gap = [sum(n * (w.get(a, 0) - w.get(b, 0)) ** 2 for (a, b), n in pairs.items()) for w in weights]
    assert pairs and gap[1] < gap[0]
    insults = pa.array(["you idiot", "such scum", "a moron", "plain words"])
    got = models[1].logits(insults)
    assert (got[:3] > got[3]).all()


def test_interchangeable_words(spark):
    """Against brute force: words between the same neighbours, each with the next of the place."""
    texts = ["the red fox ran the blue fox ran the green fox", "the green fox sat the blue dog", "red"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string")
    h = {w: int(toxicity.word_hashes([w])[0]) for t in texts for w in t.split()}
    neutral = np.sort(np.array([h[w] for w in ("red", "blue", "green")], np.uint64))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    a, b, c = sorted(("red", "blue", "green"), key=lambda w: signed(h[w]))
    assert toxicity.interchangeable(df, neutral, 10) == {(h[a], h[b]): 1, (h[b], h[c]): 1}
    assert toxicity.interchangeable(df, neutral, 1) in ({(h[a], h[b]): 1}, {(h[b], h[c]): 1})


def test_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got: dict = {}
    for r in ann.search(rows, F.col("id") % 5 == 0, shard_rows=97, query_rows=31).collect():
        got.setdefault(r.query_id, []).append(r)
    data = rows.orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in data])
    v = np.array([r.embedding for r in data], float)
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = total = 0
    for i in np.flatnonzero(ids % 5 == 0):
        c = n @ n[i]
        c[i] = -9
        mine = sorted(got[ids[i]], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert [r.score for r in mine] == pytest.approx([c[np.searchsorted(ids, r.vec_id)] for r in mine], abs=1e-12)
        hits += sum(r.score >= np.sort(c)[-5] - 1e-12 for r in mine)
        total += 5
    assert hits / total >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0]), (100, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v", "3 as score")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.search(df, F.col("id") % 50 == 0, probe_share=1.0).collect())
    assert got == [(0, 1, 2, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 1.0), (0, 4, 1, round(1 / math.sqrt(1.01), 6)), (50, 1, 0, 1.0), (50, 2, 2, 1.0), (50, 3, 2, 1.0), (50, 4, 1, round(1 / math.sqrt(1.01), 6))]
    assert ann.search(df.limit(0), F.col("id") % 50 == 0).count() == 0
