from hypothesis import given
from hypothesis import strategies as st

from lexmill.operators.segment import Matcher, Trie, maximum_matches, prefixes, word_list

CHINA = ["中", "中华", "中华人民", "中华人民共和国"]


def test_prefixes(spark):
    def found(keys, text):
        t = spark.createDataFrame([(text,)], "text string")
        return sorted((r.prefix for r in prefixes(t, spark.createDataFrame([(k,) for k in keys], "key string")).collect()), key=len)

    assert found([k for k in CHINA if k != "中华人民"], "中华人民共和国") == ["中", "中华", "中华人民共和国"]
    assert found(["天", *CHINA], "中华人民共和国") == CHINA
    outside = ["讥䶯䶰", "讥䶯䶰䶱䶲䶳", "讥䶯䶰䶱䶲䶳䶴䶵𦡦"]
    assert found(outside, "讥䶯䶰䶱䶲䶳䶴䶵𦡦") == outside
    assert found(["a", "abc", "abcdé"], "abcdé각") == ["a", "abc", "abcdé"]
    assert found(["アルゴリズム", "データ", "構造"], "データ構造とアルゴリズム") == ["データ"]
    assert found(["a"], "") == []


def test_trie():
    t = Trie.of(["a", "ab", "abc"])
    assert t.remove("ab") and not t.remove("ab") and not t.remove("zz")
    assert t.has("a") and not t.has("ab") and t.has("abc")
    assert t.remove("abc") and t.has("a") and not t["a"]


def steps(keys, text):
    return [(text[a:b], m) for a, b, m in Trie.of(keys).steps(text)]


def test_steps():
    assert steps(["ab", "abc"], "abcab") == [("abc", True), ("ab", True)]
    assert steps(["ab"], "xab") == [("x", False), ("ab", True)]
    assert steps(["abcd"], "abxab") == [("abx", False), ("ab", False)]
    assert steps(["ab"], "") == []


@given(st.lists(st.text("ab", min_size=1, max_size=3)), st.text("abc", max_size=12))
def test_steps_cover_the_text(keys, text):
    out = steps(keys, text)
    assert "".join(x for x, _ in out) == text
    assert all(x in keys for x, m in out if m)


def test_table(spark):
    docs = spark.createDataFrame([(1, "xab"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.step, r.start, r.end, r.matched) for r in maximum_matches(docs, ["ab"]).collect()] == [(1, 0, 0, 1, False), (1, 1, 1, 3, True)]
    lines = spark.createDataFrame([("b x",), ("  a",), ("",), ("b",)], "value string")
    assert [r.word for r in word_list(lines).collect()] == ["a", "b"]


def test_long_prefixes(spark):
    texts = spark.createDataFrame([("a" * 90,), ("b",), ("",), (None,)], "text string")
    keys = spark.createDataFrame([("a" * 80,), ("a",), ("b",), ("",), (None,)], "key string")
    assert sorted(r.prefix for r in prefixes(texts, keys).collect()) == ["a", "a" * 80, "b"]
    assert prefixes(texts, keys.limit(0)).count() == 0


@given(st.lists(st.text("ab.", min_size=1, max_size=3)), st.text("abc. \n", max_size=40), st.sampled_from([1, 7, 1000]))
def test_matcher(keys, text, cut):
    for most in (0, 1000):
        matcher = Matcher(Trie.of(keys), most, cut)
        for _ in range(2):
            got, start = [], 0
            for ends, matched in matcher.steps(text):
                for end, m in zip(ends.tolist(), matched.tolist()):
                    got.append((start, end, m))
                    start = end
            assert got == list(Trie.of(keys).steps(text))
    assert not Matcher(Trie.of([*keys, "a b"])).parted


def test_steps_come_in_parts():
    """A long text doesn't make one batch."""
    sizes = [len(ends) for ends, _ in Matcher(Trie.of(["ab"])).steps("ab x " * 200_000)]
    assert sum(sizes) == 4 * 200_000 and max(sizes) < 200_000
