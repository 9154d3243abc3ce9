"""Each stage on its own input, against brute force."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lexmill.llm import packing
from tests.llm.test_corpus import fingerprint, jaccard, plain, removed
from tests.llm.test_pii import spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in cp.STAGES:
        docs.append(spark.createDataFrame(stage(spark, docs[-1], SF).collect(), stage(spark, docs[-1].limit(0), SF).schema))
    return docs


def pairs(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(set(d.columns) == set(cp.COLUMNS) for d in stages[:-1])
    assert 4 <= len(cp.STAGES) <= 5 and cp.ORACLE_SQL is None


def test_quality(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = pairs(stages[0]), pairs(stages[1])
    assert all(after[k] == before[k] for k in after)
    good = [k for k in before if labels.get(k) == 1]
    assert sum(k in after for k in good) >= 0.98 * len(good)
    bad = [k for k in before if labels.get(k) == 0]
    assert sum(k not in after for k in bad) >= 0.8 * len(bad)


def test_near_duplicates(stages):
    before, after = pairs(stages[1]), pairs(stages[2])
    assert all(after[k] == before[k] for k in after)
    fps = {k: fingerprint(t) for k, t in before.items()}
    for k in before:
        twins = [j for j in before if j < k and (fps[j] == fps[k] or (fps[j] ^ fps[k]).bit_count() <= cp.NEAR_BITS and jaccard(before[j], before[k]) >= cp.SIMILARITY)]
        assert (k in after) == (not twins), (k, twins)


def test_repeats(stages):
    before, after = pairs(stages[2]), stages[3].collect()
    rows = sorted(before.items())
    tokens, gone = removed(rows, 20)
    want = {k: [w for w, g in zip(t, x) if not g] for (k, _), t, x in zip(rows, tokens, gone)}
    assert {r.doc_id: plain(r.text) for r in after} == want
    assert all(r.text == before[r.doc_id] for r, in zip(after) if len(plain(r.text)) == len(plain(before[r.doc_id])))
    assert all(r.n_chars == len(r.text) for r in after)


def test_personal_data(stages):
    before, after = pairs(stages[3]), pairs(stages[4])
    assert set(before) == set(after)
    for k, t in before.items():
        if not spans(t):
            assert after[k] == t
        else:
            assert re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", after[k]) and not spans(after[k])


def test_packing(stages):
    after, pieces = pairs(stages[4]), stages[5].collect()
    assert {p.doc_id for p in pieces} == set(after)
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert stages[5].columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]


def test_odd_rows(spark, docs, none):
    labels = "/root/testdata/sf0.001"
    part = docs.select(*cp.COLUMNS)
    for _, stage in cp.STAGES[1:]:
        assert stage(spark, part, labels).count() > 0
        assert stage(spark, none.select(*cp.COLUMNS), labels).count() == 0
    twice = cp.without_near_duplicates(spark, part, labels)
    assert twice.where("doc_id = 7").count() == 1 and twice.where(F.col("doc_id").isNull()).count() == 2


def test_run(spark):
    assert cp.run(spark, SF).count() > 0
