import random

import pytest

COMMON = "the of and to in a is that for it on with as was be by".split()


def sentence(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.5 else "".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, shared passages, odd white space, nulls, repeated rows and ids."""
    rng = random.Random(5)
    base = [sentence(rng, rng.choice([1, 2, 5, 30, 80, 200])) for _ in range(40)]
    passage = sentence(rng, 45)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(6)]
    rows += [(200 + i, base[20 + i] + " extra") for i in range(6)]
    rows += [(300 + i, f"{sentence(rng, 10 * i)} {passage}\n\n{sentence(rng, 7)}") for i in range(5)]
    rows += [(400, ""), (401, None), (402, " \t\n "), (403, "Grüße an  ALLE\x0bWörter 😀 " * 12), (404, "na " * 70), (405, "x" * 3000), (406, "THE Of and"), (None, base[0]), (None, None), (7, base[7]), (7, base[7])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names clash with those that operators use."""
    rows = [(k, t, "en", "s", k) for k, t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 as k", "'x' as t", "2 as b", "3 as q", "'y' as data", "4 as fp", "5 as score", "6 as spans", "7 as row").repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
