import hashlib
import math
import random
import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexmill.llm import pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def counts(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in p.finditer(text or "") if counts(k, m.group())]


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as t", "2 as spans", "3 as row")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    for k, text in enumerate(texts):
        base = spans(text)
        joined = ",".join(f"{a}:{b}:{c}" for a, b, c in base)
        r = got[k]
        assert (r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) == (hashlib.sha256(joined.encode()).hexdigest(), *[sum(s[0] == kind for s in base) for kind in BASE]), text
        assert r.spans == joined or r.spans.startswith(joined)
    return got


HARD = [
    "a@b.c_x@y.z", "a@b.c..d@e.f", "@@a@b.c", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1", "0001.02.255.0256 0001.2.3.0255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567+49 30 1234567",
    "x" * 60_000, "1" * 60_000, "1 " * 20_000 + "4111 1111  1111 1111", "a@" + "b.c" * 5_000, "é😀 a@b.co 😀+441234567890é", "+1+1+1234567 8", "4111111111111111 4111111111111111", None, "", "\na.b@c.d.\n+123 4567-8.",
    "12345678901234567890 4111111111111111-", "a@b.c d@e.f a@b.c", "-@-.-", "%@1.1 ..@a.b", "٣٣٣.1.1.1 ４@ａ.ｂ", "1" + ".1" * 5_000,
]


def test_hard_cases(spark):
    check(spark, HARD)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("a1.@+ -()2é_%", max_size=40), min_size=200, max_size=200))
def test_random_texts(spark, texts):
    check(spark, [*texts, "4111 1111 1111 1111"])


def corpus(contexts):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(400):
        body = " ".join(rng.choices(words, k=30))
        out.append(body + (f" Zorblatt, w{i % 7 if contexts else 1} zz@corp.com then w{i % 5 if contexts else 1} " + (" ".join(rng.choices(words, k=12)) if contexts else "w3 " * 40) if i % 20 == 0 else ""))
    return out


def test_terms_that_disclose(spark):
    texts = corpus(True)
    got = check(spark, texts)
    found = {(k, texts[k][int(s.split(":")[1]) : int(s.split(":")[2])]) for k, r in got.items() for s in r.spans.split(",") if s.startswith("term")}
    assert {k for k, w in found if w == "Zorblatt"} == set(range(0, 400, 20))
    assert all(w in ("Zorblatt", "then") for _, w in found)


def test_terms_are_marked_everywhere(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    some = lambda n: " ".join(rng.choices(words, k=n))
    texts = [some(40) for _ in range(400)]
    for i in range(0, 400, 20):
        texts[i] = f"{some(9)} Zorblatt, {some(9)} zz@corp.com {some(60)} ZORBLATT! {some(60)} (quixlorp) {some(5)}"
    texts[7] += " zorblatt again"
    got = check(spark, texts)
    marked = {(k, m.start()) for k, r in got.items() for m in re.finditer("zorblatt|quixlorp", texts[k].lower())}
    assert {(k, int(s.split(":")[1])) for k, r in got.items() for s in r.spans.split(",") if s.startswith("term")} == marked and len(marked) == 61
    out = pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert not any(re.search("(?i)zorblatt|quixlorp", r.text) for r in out) and len(out) == 400


def test_terms_against_an_entity(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=40)) + (f" {rng.choice(words)} Zorblatt<zz@corp.com> {rng.choice(words)}" if i % 20 == 0 else "") for i in range(400)]
    got = check(spark, texts)
    assert {k: texts[k][int(s.split(":")[1]) : int(s.split(":")[2])] for k, r in got.items() for s in r.spans.split(",") if s.startswith("term")} == {k: "Zorblatt" for k in range(0, 400, 20)}


def test_copies_prove_nothing(spark):
    text = "Only here: Quixlorp wrote from zz@corp.com about blumgarten matters"
    got = check(spark, [text] * 30 + ["other words entirely"] * 30)
    assert not any("term" in r.spans for r in got.values())


def test_sanitised(spark):
    texts = [*HARD[:8], None, "", "plain text\n stays", *corpus(True)[:1]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, t string").selectExpr("*", "1 as spans", "2 as row", "3 as new", "4 as _all")
    out = pii.sanitise(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert len(got) == len(texts)
    assert got[0] == "[EMAIL][EMAIL]" and got[3] == "[IP].[IP]" and got[5] == "0001.02.255.0256 [IP]" and got[6] == "[CARD] and 4111-1111-1111-1112"
    assert got[8] is None and got[9] == "" and got[10] == "plain text\n stays" and "@" not in got[11]
    assert pii.sanitise(df.limit(0)).count() == 0 and pii.find(df.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, "a@b.c"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_email) for r in pii.find(df).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]
    assert sorted((r.doc_id or 0, r.text or "") for r in pii.sanitise(df).collect()) == [(0, ""), (0, "[EMAIL]"), (1, "[EMAIL]"), (1, "[EMAIL]")]


def test_occurrences(spark):
    docs = spark.createDataFrame([(1, "a b, A"), (2, "b"), (3, ""), (2, "b")], "row long, t string")
    terms = spark.createDataFrame([("a",), ("b",), ("z",)], "term string")
    common = spark.createDataFrame([("c",)], "term string")
    assert sorted((r.row, r.term) for r in pii.occurrences(docs, terms, common).collect()) == [(1, "a"), (1, "b"), (2, "b")]


def brute_terms(texts, around=80, kinds=3, bits=7.0, share=0.95):
    """Disclosing terms by the definition, from each document's words and mentions."""
    blanked, mentions, holders = [], {}, {}
    for k, t in enumerate(texts):
        t, found, cut = t or "", spans(t), t or ""
        for _, s, e in found:
            cut = cut[:s] + " " * (e - s) + cut[e:]
        blanked.append(cut)
        for kind, s, e in found:
            value = re.sub("[^0-9]", "", t[s:e]) if kind in ("card", "phone") else t[s:e].lower()
            sides = []
            for x in (t, cut):
                left, right = x[max(0, s - around) : s], x[e : e + around]
                if s > around:
                    first = re.match(r"[^\x20\x09-\x0D]*", left).end()
                    left = " " * first + left[first:]
                if len(t) > e + around:
                    right = re.sub(r"[^\x20\x09-\x0D]+\Z", "", right)
                sides.append((left, right))
            mentions.setdefault((kind, value), []).append((sides[0], bag(" ".join(sides[1]))))
            holders.setdefault((kind, value), set()).add(k)
    words = [bag(c) for c in blanked]
    df = Counter(w for ws in words for w in ws)
    n, out = len(texts), set()
    for e, docs in holders.items():
        ic = math.log2(n / len(docs))
        near: dict = {}
        for where, ws in mentions[e]:
            for w in ws:
                near.setdefault(w, set()).add(where)
        far: dict = {}
        for k in docs:
            for w in words[k]:
                far.setdefault(w, set()).add(k)
        for w in {*near, *(w for w in far if len(far[w]) >= kinds)}:
            pmi = math.log2(n * len(far[w]) / df[w] / len(docs)) if w in far else -1
            if ic > 0 and pmi >= share * ic - 1e-12 and (len(near.get(w, ())) >= kinds or len(far[w]) >= kinds or pmi >= bits):
                out.add(w)
    return out, words


def bag(text):
    return {w for w in (x.strip(pii._EDGES).lower() for x in re.split(r"[\x20\x09-\x0D]", text)) if w}


def test_terms_by_brute_force(spark):
    """Rare names beside one mention, names over many, footers, and common words; each document is of its own kind."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(500):
        t = " ".join(rng.choices(words, k=25))
        if i % 25 == 3:
            t += f" Name{i} Surname{i % 50} wrote from p{i}@corp.com about w{i % 9} x{i} {' '.join(rng.choices(words, k=25))} far{i}"
        if i % 9 == 1:
            t += f" call +44 20 7946 0{i % 3}58 office{i % 3} {rng.choice(words)}"
        texts.append(f"{t} end{i % 4}")
    terms, held = brute_terms(texts)
    want = {(k, w) for k, ws in enumerate(held) for w in ws & terms}
    got = check(spark, texts)
    mine = {(k, texts[k][int(s.split(":")[1]) : int(s.split(":")[2])].lower()) for k, r in got.items() for s in r.spans.split(",") if s.startswith("term")}
    assert mine == want and {"name3", "office1", "x28"} <= terms and not {"w1", "far3", "end1", "wrote"} & terms


def test_terms_of_the_tables(spark):
    """The method adds spans on the test tables: words that stand beside one address and nowhere else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.find(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = [(r.doc_id, s.split(":")) for r in rows for s in r.spans.split(",") if s.startswith("term")]
    assert len(rows) == len(texts) and len(found) > 50
    terms, held = brute_terms([texts[k] for k in sorted(texts)])
    assert {texts[k][int(s[1]) : int(s[2])].lower() for k, s in found} == {w for ws in held for w in ws & terms}


def test_main_path_has_no_python(spark, small):
    plan = pii.find(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
