import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.operators.lattice import Chains, CharClass, Entry, Lexicon, Segmenter, Switches, cheapest_path, lexicon_of, real_costs, tokenise, tokens_of


def path(nodes, edges=(), first=(), last=()):
    edges, first, last = dict(edges), dict(first), dict(last)
    return cheapest_path([a for a, _ in nodes], [b for _, b in nodes], lambda i, js: [edges.get((i, j), 0) for j in js], lambda i: first.get(i, 0), lambda i: last.get(i, 0))


LONG = [(0, 1), (0, 4), (1, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize("nodes,edges,first,last,expected", [
    ([], (), (), (), ([], 0)),
    ([(0, 1)], (), (), (), ([0], 0)),
    ([(0, 10), (0, 5)], (), [(0, 1000)], (), ([0], 1000)),
    ([(0, 1), (1, 2)], [((0, 1), 1)], (), (), ([0, 1], 1)),
    ([(0, 1), (0, 1), (1, 2), (1, 2), (2, 3)], [((0, 2), 100), ((1, 2), 100), ((1, 3), 100), ((3, 4), 10000)], (), (), ([0, 2, 4], 100)),
    (LONG, (), (), (), ([1], 0)),
    (LONG, (), [(0, 1)], (), ([1], 0)),
    (LONG, (), [(1, 1)], (), ([0, 2, 3, 4], 0)),
    (LONG, (), [(1, 1)], [(4, 2)], ([1], 1)),
])
def test_paths(nodes, edges, first, last, expected):
    assert path(nodes, edges, first, last) == expected


CLASSES = {"DEFAULT": CharClass("DEFAULT", False, 1), "ALPHA": CharClass("ALPHA", True, 0, True), "KANJI": CharClass("KANJI", False, 2), "LINE": CharClass("LINE")}
RANGES = [(10, 10, ("LINE",)), (97, 122, ("ALPHA",)), (0x4E00, 0x9FFF, ("KANJI",))]
UNKNOWN = {"DEFAULT": [Entry(1, 1, 900)], "ALPHA": [Entry(1, 1, 300)], "KANJI": [Entry(1, 1, 800)], "LINE": [Entry(0, 0, 0)]}
WORDS = {w: [Entry(1, 1, c)] for w, c in {"これ": 10, "を": 10, "持っ": 10, "て": 10, "いけ": 10, "program": 10, "m": 400, "噛": 2000}.items()}


def lexicon(**more):
    return Lexicon(WORDS, np.zeros((2, 2), np.int16), CLASSES, RANGES, UNKNOWN, **more)


def cut(text, lex=None, **switches):
    return [text[t.start : t.end] for t in tokenise(lex or lexicon(), text, Switches(**switches))[0]]


def test_samples():
    assert cut("これ") == ["これ"]
    assert cut("これを持っていけ") == ["これ", "を", "持っ", "て", "いけ"]
    assert cut("噛 ") == ["噛"]
    assert cut("噛\n") == ["噛", "\n"]
    assert cut("a b") == ["a", "b"] and cut("a b", strip_spaces=False) == ["a", " ", "b"]
    assert cut("programmprogram") == ["programmprogram"]
    assert cut("programmprogram", forced_unknown=False) == ["program", "m", "program"]
    assert cut("鬱鬱") == ["鬱鬱"] and cut("鬱鬱", prefix_groups=False, greedy_groups=False) == ["鬱", "鬱"]
    assert cut("」   ") == ["」"]
    assert cut("これを", lexicon(user={"これを": [Entry(0, 0, -100)]})) == ["これを"]
    assert tokenise(lexicon(), "") == ([], 0)
    with pytest.raises(ValueError):
        tokenise(lexicon(), "   ")


@settings(max_examples=60, deadline=None)
@given(st.text("ab ", min_size=1, max_size=7).filter(str.strip), st.dictionaries(st.text("ab", min_size=1, max_size=3), st.tuples(st.integers(0, 1), st.integers(0, 1), st.integers(-5, 20)), max_size=6), st.lists(st.integers(-9, 9), min_size=4, max_size=4))
def test_against_all_segmentations(text, words, m):
    matrix = np.array(m, np.int16).reshape(2, 2)
    lex = Lexicon({w: [Entry(*e)] for w, e in words.items()}, matrix, {}, [], {"DEFAULT": [Entry(0, 1, 30)]})
    best = None
    spaceless = text.replace(" ", "")
    breaks = {i for i in range(len(spaceless)) if len(text[: [k for k, c in enumerate(text) if c != " "][i]].replace(" ", "")) == i and i and text[[k for k, c in enumerate(text) if c != " "][i] - 1] == " "}
    for bits in itertools.product([0, 1], repeat=len(spaceless) - 1):
        cuts = [0, *[i + 1 for i, b in enumerate(bits) if b], len(spaceless)]
        if breaks - set(cuts):
            continue
        options = []
        for a, b in zip(cuts, cuts[1:]):
            w = spaceless[a:b]
            found = [Entry(*words[w])] if w in words else []
            if not found and b == a + 1 and not any(spaceless[a : a + n] in words and not breaks & set(range(a + 1, a + n)) for n in range(1, 4)):
                found = [Entry(0, 1, 30)]
            options.append(found)
        for chosen in itertools.product(*options):
            cost = sum(e.cost for e in chosen) + sum(int(matrix[x, y]) for x, y in zip([0, *[e.right for e in chosen]], [*[e.left for e in chosen], 0]))
            best = cost if best is None else min(best, cost)
    if best is not None:
        assert tokenise(lex, text)[1] == best


@settings(max_examples=120, deadline=None)
@given(
    st.lists(st.text("abX鬱\n  ", min_size=1, max_size=25).filter(lambda t: t.strip(" ")), min_size=1, max_size=4),
    st.dictionaries(st.text("abX", min_size=1, max_size=3), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(-3, 6)), min_size=1, max_size=2), max_size=8),
    st.lists(st.integers(-3, 3), min_size=9, max_size=9),
    st.booleans(),
)
def test_pieces_as_whole_texts(texts, words, m, crossing):
    """Remembered pieces give the whole text's tokens, ties included; where a word may cross a space, the text is one piece."""
    if crossing:
        words = words | {"a b": [(0, 1, -9)]}
    lex = Lexicon({w: [Entry(*e) for e in es] for w, es in words.items()}, np.array(m, np.int16).reshape(3, 3), CLASSES, RANGES, {n: [Entry(e.left, e.right, e.cost // 100) for e in es] for n, es in UNKNOWN.items()})
    known = Segmenter(lex)
    assert known.parted != crossing
    for text in texts * 2:
        found = tokenise(lex, text)[0]
        assert known.tokens(text) == [(text[t.start : t.end], t.kind, t.entry.feature, c) for t, c in zip(found, real_costs(lex, found))]


def test_table(spark):
    docs = spark.createDataFrame([(1, "これを\n持っ"), (2, None), (3, ""), (4, "  "), (None, "を"), (5, "を"), (5, "を")], "doc_id long, text string").selectExpr("*", "1 as cost", "'x' as content")
    rows = tokens_of(docs, lexicon()).collect()
    assert [(r.line_index, r.token_index, r.content) for r in rows if r.doc_id == 1] == [(0, 0, "これ"), (0, 1, "を"), (1, 0, "持っ")]
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 1, 1, 5, 5]
    assert tokens_of(docs.limit(0), lexicon()).count() == 0


def test_lexicon_is_bounded(spark):
    words = spark.createDataFrame([("a", 0, 0, 1, ""), ("b", 0, 0, 1, "")], "surface string, left int, right int, cost long, feature string")
    assert set(lexicon_of(words, np.zeros((1, 1)), {}, [], UNKNOWN).words) == {"a", "b"}
    with pytest.raises(ValueError):
        lexicon_of(words, np.zeros((1, 1)), {}, [], UNKNOWN, most=1)


@settings(max_examples=80, deadline=None)
@given(
    st.lists(st.text("abX鬱.\n  ", max_size=25), min_size=1, max_size=4),
    st.dictionaries(st.text("abX", min_size=1, max_size=3), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(-3, 6)), min_size=1, max_size=2), max_size=8),
    st.lists(st.integers(-3, 3), min_size=9, max_size=9),
    st.sampled_from([1, 3, 1000]),
    st.booleans(),
)
def test_chains(texts, words, m, part, starts_line):
    """Tokens as numbers are those of the whole text, with lines and indices counted one by one."""
    lex = Lexicon({w: [Entry(*e) for e in es] for w, es in words.items()}, np.array(m, np.int16).reshape(3, 3), CLASSES, RANGES, {n: [Entry(e.left, e.right, e.cost // 100) for e in es] for n, es in UNKNOWN.items()})
    known = Chains(Segmenter(lex), starts_line, part)
    for text in texts * 2:
        expected, line, index = [], 0, 0
        found = tokenise(lex, text)[0] if text.strip(" ") else []
        for t, cost in zip(found, real_costs(lex, found)):
            content = text[t.start : t.end]
            if content == "\n" or starts_line and content.startswith("\n"):
                line, index = line + 1, 0
                continue
            expected.append((7, line, index, content, t.kind, t.entry.feature, cost))
            index += 1
        rows = [(7, lines, indices, where) for where, lines, indices in known.tokens(text)]
        got = [tuple(r.values()) for r in known.rows(rows).to_pylist()] if rows else []
        assert got == expected


def test_marks_are_pieces_of_their_own():
    """A word is remembered whatever mark or line break is next to it."""
    assert Segmenter(lexicon()).pieces("ab. ab\nab,  ab") == ["ab", ".", " ab", "\n", "ab", ",", "  ab"]
