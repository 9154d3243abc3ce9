"""Morphological segmentation: the cheapest path through a lattice of dictionary and unknown words."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.functions.shared import shared


@dataclass(frozen=True)
class Entry:
    """A word: its connection classes on either side, its cost, and whatever the lexicon says of it."""

    left: int
    right: int
    cost: int
    feature: str = ""


@dataclass(frozen=True)
class CharClass:
    """How characters that start an unknown word are grouped."""

    name: str
    greedy: bool = False
    prefix_len: int = 0
    always: bool = False


class Token(NamedTuple):
    start: int
    end: int
    kind: str  # normal, user or unknown
    entry: Entry
    rank: int = 0


@dataclass
class Lexicon:
    """A bounded resource: words by spelling, connection costs, character classes and unknown words by class.

    ranges: (first, last, classes) of code points; the first class is the one that a word starting with the
    character takes, all of them are compatible. Characters in no range have class DEFAULT.
    """

    words: dict[str, list[Entry]]
    matrix: np.ndarray  # [right class of the left word, left class of the right word]
    classes: dict[str, CharClass]
    ranges: Sequence[tuple[int, int, tuple[str, ...]]]
    unknown: dict[str, list[Entry]]
    user: dict[str, list[Entry]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        #: All beginnings of words, with the (kind, entry) of those that are words themselves.
        self.prefixes: dict[str, list[tuple[str, Entry]]] = {w[:i]: [] for words in (self.words, self.user) for w in words for i in range(1, len(w) + 1)}
        for kind, words in (("normal", self.words), ("user", self.user)):
            for w, entries in words.items():
                if w:
                    self.prefixes[w] += [(kind, e) for e in entries]
        self.connections = np.asarray(self.matrix).tolist()
        self._class_of = {c: self.classes.get(c, CharClass(c)) for names in (n for *_, n in self.ranges) for c in names} | {"DEFAULT": self.classes.get("DEFAULT", CharClass("DEFAULT"))}
        self._classes: dict[str, tuple[str, ...]] = {}

    def classes_of(self, c: str) -> tuple[str, ...]:
        found = self._classes.get(c)
        if found is None:
            found = next((names for a, b, names in self.ranges if a <= ord(c) <= b), ("DEFAULT",))
            self._classes[c] = found
        return found


@dataclass(frozen=True)
class Switches:
    strip_spaces: bool = True
    forced_unknown: bool = True
    greedy_groups: bool = True
    prefix_groups: bool = True


def tokens_at(lexicon: Lexicon, text: str, rank: int, sw: Switches, runs: dict[str, tuple[int, int]] | None = None) -> tuple[list[Token], int]:
    """Tokens whose rank is this place (spaces before a word belong to its rank), and the spaces passed.

    runs remembers, for one text, the last run of compatible characters of each class.
    """
    start = rank
    if sw.strip_spaces:
        while start < len(text) and text[start] == " ":
            start += 1
    if start == len(text):
        return [], start - rank
    out: list[Token] = []
    end, length, known_prefix = start + 1, len(text), lexicon.prefixes.get
    while end <= length and (words := known_prefix(text[start:end])) is not None:
        for kind, e in words:
            out.append(Token(start, end, kind, e, rank))
        end += 1
    name = lexicon.classes_of(text[start])[0]
    char_class = lexicon._class_of[name]
    if (sw.greedy_groups or sw.prefix_groups) and (not out or sw.forced_unknown and char_class.always):
        greedy = sw.greedy_groups and char_class.greedy
        longest = char_class.prefix_len if sw.prefix_groups else 0
        known = runs.get(name, (0, 0)) if runs is not None else (0, 0)
        run = known[1] if greedy and known[0] <= start < known[1] else start
        classes_of = lexicon._classes.get
        while run < length and name in (classes_of(text[run]) or lexicon.classes_of(text[run])) and (greedy or run - start < max(longest, 1)):
            run += 1
        if greedy and runs is not None:
            runs[name] = (start, run)
        for e in lexicon.unknown.get(name, ()):
            if greedy:
                out.append(Token(start, run, "unknown", e, rank))
            out += [Token(start, start + n, "unknown", e, rank) for n in range(1, min(longest, run - start) + 1)]
    for fallback in (name, "DEFAULT"):
        if not out and lexicon.unknown.get(fallback):
            out.append(Token(start, start + 1, "unknown", lexicon.unknown[fallback][0], rank))
    if not out:
        raise ValueError("the unknown words have no DEFAULT entry")
    return out, start - rank


def cheapest_path(ranks: Sequence[int], nexts: Sequence[int], edge, first, last) -> tuple[list[int], int]:
    """Nodes of least total cost from the first rank on, and that cost.

    Nodes are sorted by rank; node i is followed by those whose rank is nexts[i]. edge(i, js) gives the
    costs of stepping from i to each of js, first(i) and last(i) those of the ends. Only nodes that end
    furthest may be last. Of equal costs the earlier node wins.
    """
    n = len(ranks)
    if not n:
        return [], 0
    where: dict[int, list[int]] = {}
    for i, r in enumerate(ranks):
        where.setdefault(r, []).append(i)
    furthest, top = max(nexts), ranks[-1]
    cost: list[int | None] = [None] * n
    source = [-1] * n
    for i in where[ranks[0]]:
        cost[i] = first(i)
    best, best_cost = 0, None
    for i in range(n):
        if cost[i] is None:
            continue
        if nexts[i] > top:
            if nexts[i] == furthest and (best_cost is None or cost[i] + last(i) < best_cost):
                best, best_cost = i, cost[i] + last(i)
            continue
        after = where.get(nexts[i], [])
        for j, c in zip(after, edge(i, after)):
            if cost[j] is None or cost[i] + c < cost[j]:
                cost[j], source[j] = cost[i] + c, i
    path = [best]
    while source[path[-1]] >= 0:
        path.append(source[path[-1]])
    return path[::-1], (cost[best] or 0) + last(best)


def _lattice(lexicon: Lexicon, text: str, sw: Switches, incoming: Sequence[tuple[int, int]] | None = None):
    """Nodes, their costs and sources, the nodes by the place they end at, and the furthest such place.

    The lattice is built from left to right, and only at places that some word ends at; of the words
    that end there, the cheapest of each right class is what later ones can follow. Ties are broken as in
    cheapest_path(). incoming: (right class, cost) of what stands before the text, as nodes of their own, in order;
    None at the beginning of all.
    """
    m = lexicon.connections
    nodes: list[Token | None] = [None for _ in incoming or ()]
    costs: list[int] = [c for _, c in incoming or ()]
    source: list[int] = [-1] * len(costs)
    ending: dict[int, dict[int, int]] = {0: {right: i for i, (right, _) in enumerate(incoming or ())}}  # by place: the node to follow, by right class
    places = [0]
    furthest = 0
    runs: dict[str, tuple[int, int]] = {}
    while places:
        rank = heappop(places)
        before = ending[rank]
        found = tokens_at(lexicon, text, rank, sw, runs)[0]
        for token in found:
            entry = token.entry
            if rank == 0 and incoming is None:
                best, cost = -1, m[0][entry.left]
            else:
                best, cost = -1, None
                for right, i in before.items():
                    c = costs[i] + m[right][entry.left]
                    if cost is None or c < cost or c == cost and i < best:
                        best, cost = i, c
            here = len(nodes)
            nodes.append(token)
            costs.append(cost + entry.cost)
            source.append(best)
            ends = ending.get(token.end)
            if ends is None:
                ends = ending[token.end] = {}
                heappush(places, token.end)
                furthest = max(furthest, token.end)
            other = ends.get(entry.right)
            if other is None or costs[here] < costs[other]:
                ends[entry.right] = here
    return nodes, costs, source, ending, furthest


def tokenise(lexicon: Lexicon, text: str, sw: Switches = Switches()) -> tuple[list[Token], int]:
    """The cheapest segmentation and its cost; none and 0 for the empty text. A text of spaces only raises ValueError."""
    if not text:
        return [], 0
    nodes, costs, source, ending, furthest = _lattice(lexicon, text, sw)
    if not nodes:
        raise ValueError("nothing but spaces")
    cost, last = min((costs[i] + int(lexicon.matrix[right, 0]), i) for right, i in ending[furthest].items())
    path = [last]
    while source[path[-1]] >= 0:
        path.append(source[path[-1]])
    return [nodes[i] for i in path[::-1]], cost


class Segmenter:
    """tokenise() piece by piece, with a memory of what pieces came to.

    Where no word crosses a space, every path passes through each place before one; likewise on either side of a character that
    is always a word by itself, as marks and line breaks are. What a piece of text (spaces, then such a character or a run of
    others) comes to depends on nothing but the right classes that may stand before it, what they cost more than the
    cheapest, and their order, which decides ties. So each piece is worked out once for each such state.
    """

    def __init__(self, lexicon: Lexicon, sw: Switches = Switches(), most: int = 200_000, longest: int = 64):
        self.lexicon, self.sw, self.most, self.longest = lexicon, sw, most, longest
        self.known: dict = {}
        alone = lambda names: all(not (c := lexicon.classes.get(n, CharClass(n))).greedy and c.prefix_len <= 1 for n in names)
        self.parted = sw.strip_spaces and alone(lexicon.classes_of(" ")) and not any(" " in w for words in (lexicon.words, lexicon.user) for w in words)
        pattern = " *[^ ]+"
        if alone(("DEFAULT",)):
            longer = {c for words in (lexicon.words, lexicon.user) for w in words if len(w) > 1 for c in w} - {" "}
            others = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b, names in lexicon.ranges if not alone(names) and not a <= 32 <= b) + "".join(map(re.escape, sorted(longer)))
            if others and not any(a <= 32 <= b for a, b, _ in lexicon.ranges):
                pattern = f" *(?:[{others}]+|[^ {others}])"
        self.pieces = re.compile(pattern).findall

    def piece(self, text: str, state: tuple | None) -> tuple[list, tuple, int]:
        """Outcomes (place in the state before, tokens as (content, kind, feature, cost)), the state after, and the cost of its cheapest."""
        nodes, costs, source, ending, furthest = _lattice(self.lexicon, text, self.sw, state)
        ends = sorted(ending[furthest].items(), key=lambda x: x[1])
        if len(ends) > 1:  # what is dearer than another whatever follows is never followed
            ahead = np.array([costs[i] for _, i in ends])[:, None] + self.lexicon.matrix[[right for right, _ in ends]]
            ends = [e for j, e in enumerate(ends) if not (ahead < ahead[j]).all(1).any()]
        least = min(costs[i] for _, i in ends)
        outcomes = []
        for _, i in ends:
            path = [i]
            while source[path[-1]] >= 0:
                path.append(source[path[-1]])
            begin = path.pop() if state is not None else -1
            tokens = [nodes[k] for k in path[::-1]]
            rights = [state[begin][0] if state is not None else 0, *[t.entry.right for t in tokens]]
            outcomes.append((begin, [(text[t.start : t.end], t.kind, t.entry.feature, t.entry.cost + int(self.lexicon.matrix[r, t.entry.left])) for r, t in zip(rights, tokens)]))
        return outcomes, tuple((right, costs[i] - least) for right, i in ends), least

    def tokens(self, text: str) -> list[tuple[str, str, str, int]]:
        """(content, kind, feature, cost) of the cheapest segmentation's tokens."""
        if not text.strip(" "):
            return []
        if len(self.known) > self.most:
            self.known.clear()
        steps, state = [], None
        for piece in self.pieces(text) if self.parted else [text]:
            key = (piece, state)
            found = self.known.get(key)
            if found is None:
                found = self.piece(piece, state)
                if len(piece) <= self.longest:
                    self.known[key] = found
            steps.append(found[0])
            state = found[1]
        at = min(range(len(state)), key=lambda i: (state[i][1] + int(self.lexicon.matrix[state[i][0], 0]), i))
        chains = []
        for outcomes in reversed(steps):
            at, chain = outcomes[at]
            chains.append(chain)
        return [t for chain in reversed(chains) for t in chain]


def real_costs(lexicon: Lexicon, tokens: Sequence[Token]) -> list[int]:
    """Each token's own cost and that of its connection to the one before."""
    before = [0, *[t.entry.right for t in tokens]]
    return [t.entry.cost + int(lexicon.matrix[b, t.entry.left]) for b, t in zip(before, tokens)]


def tokens_of(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", sw: Switches = Switches(), starts_line: bool = False) -> DataFrame:
    """(doc_id, line_index, token_index, content, kind, feature, cost) for every token of every text.

    The text is segmented as a whole, then parted into lines at tokens that are a line break (starts_line:
    that begin with one). The line breaks themselves are left out. Null, empty and all-space texts
    have no tokens. The lexicon is broadcast once; texts aren't shuffled.
    """
    resource = shared(docs.sparkSession, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Chains(Segmenter(resource(), sw), starts_line)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            texts = batch.column("t")
            for i, doc in enumerate(batch.column("k").to_pylist()):  # one text at a time, however long they are
                for where, line, index in known.tokens(texts[i].as_py() or ""):
                    rows.append((doc, line, index, where))
                    held += len(where)
                    if held > 100_000:
                        yield known.rows(rows)
                        rows, held = [], 0
                if known.full():
                    if rows:
                        yield known.rows(rows)
                    rows, held = [], 0
                    known.forget()
        if rows:
            yield known.rows(rows)

    return docs.selectExpr(f"cast(`{id_col}` as long) as k", f"`{text_col}` as t").mapInArrow(run, "doc_id long, line_index int, token_index int, content string, kind string, feature string, cost long")


class Strings:
    """Strings by number, as an Arrow array that grows."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.new: list[str] = []
        self.held = pa.array([], pa.string())

    def of(self, value: str) -> int:
        found = self.ids.get(value)
        if found is None:
            found = self.ids[value] = len(self.ids)
            self.new.append(value)
        return found

    def take(self, ids: np.ndarray) -> pa.Array:
        if self.new:
            self.held = pa.concat_arrays([self.held, pa.array(self.new, pa.string())])
            self.new = []
        return self.held.take(pa.array(ids))


class Chains:
    """The tokens of a Segmenter's pieces as numbers: what a piece comes to after a state is worked out and written down once.

    For each state there is a memory of pieces: (the memory after the piece, its outcomes, the number of the only one or -1).
    An outcome is (place in the state before, number); a number stands for a run of tokens in flat arrays.
    """

    def __init__(self, segmenter: Segmenter, starts_line: bool = False, part: int = 100_000):
        self.segmenter, self.starts_line, self.part = segmenter, starts_line, part
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple | None, dict] = {}
        self.state_of: dict[int, tuple | None] = {}
        self.size = 0
        self.first, self.count = array("q"), array("q")  # by number
        self.content, self.kind, self.feature, self.cost, self.breaks = array("q"), array("q"), array("q"), array("q"), array("b")  # by token
        self.contents, self.kinds, self.features = Strings(), Strings(), Strings()

    def full(self) -> bool:
        """Then rows() must be given all there is, and forget() be called."""
        return self.size > self.segmenter.most or len(self.content) > 20 * self.segmenter.most

    def memory(self, state: tuple | None) -> dict:
        found = self.states.get(state)
        if found is None:
            found = self.states[state] = {}
            self.state_of[id(found)] = state
        return found

    def learn(self, piece: str, before: dict) -> tuple[dict, list[tuple[int, int]], int]:
        outcomes, state, _ = self.segmenter.piece(piece, self.state_of[id(before)])
        numbered = []
        for begin, tokens in outcomes:
            numbered.append((begin, len(self.first)))
            self.first.append(len(self.content))
            self.count.append(len(tokens))
            for content, kind, feature, cost in tokens:
                self.content.append(self.contents.of(content))
                self.kind.append(self.kinds.of(kind))
                self.feature.append(self.features.of(feature))
                self.cost.append(cost)
                self.breaks.append(content == "\n" or self.starts_line and content.startswith("\n"))
        found = self.memory(state), numbered, numbered[0][1] if len(numbered) == 1 else -1
        self.size += 1
        if len(piece) <= self.segmenter.longest:
            before[piece] = found
        return found

    def tokens(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the flat arrays, line, index) of the tokens, without line breaks, some at a time."""
        if not text.strip(" "):
            return
        here, steps = self.memory(None), []
        for piece in self.segmenter.pieces(text) if self.segmenter.parted else [text]:
            found = here.get(piece) or self.learn(piece, here)
            steps.append(found)
            here = found[0]
        state, matrix = self.state_of[id(here)], self.segmenter.lexicon.matrix
        at = min(range(len(state)), key=lambda i: (state[i][1] + int(matrix[state[i][0], 0]), i))
        numbers = np.array([s[2] for s in steps], np.int64)
        after = len(steps)
        for i in np.flatnonzero(numbers < 0)[::-1].tolist():
            if i + 1 < after and i + 1 < len(steps):  # what follows has one outcome
                at = steps[i + 1][1][0][0]
            at, numbers[i] = steps[i][1][at]
            after = i
        line = index = 0
        first, count = np.frombuffer(self.first, np.int64)[numbers], np.frombuffer(self.count, np.int64)[numbers]
        ends = np.cumsum(count)
        done = 0
        while done < len(numbers):
            to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + self.part, "right")))
            n = count[done:to]
            where = np.repeat(first[done:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            done = to
            broken = np.frombuffer(self.breaks, np.int8)[where] != 0
            lines = line + np.cumsum(broken)
            seen = index + np.cumsum(~broken)
            base = np.maximum.accumulate(np.where(broken, seen, 0))
            keep = ~broken
            if keep.any():
                yield where[keep], lines[keep], (seen - base - 1)[keep]
            if len(where):
                line, index = int(lines[-1]), int(seen[-1] - base[-1])

    def rows(self, rows: list[tuple]) -> pa.RecordBatch:
        """The batch of some (doc, line, index, place in the flat arrays)."""
        names = ["doc_id", "line_index", "token_index", "content", "kind", "feature", "cost"]
        sizes = [len(r[3]) for r in rows]
        ids = pa.array(np.repeat(np.array([r[0] or 0 for r in rows], np.int64), sizes), mask=np.repeat(np.array([r[0] is None for r in rows]), sizes))
        line, index, where = (np.concatenate([r[k] for r in rows]) for k in (1, 2, 3))
        text = [strings.take(np.frombuffer(of, np.int64)[where]) for strings, of in ((self.contents, self.content), (self.kinds, self.kind), (self.features, self.feature))]
        return pa.RecordBatch.from_arrays([ids, pa.array(line.astype(np.int32)), pa.array(index.astype(np.int32)), *text, pa.array(np.frombuffer(self.cost, np.int64)[where])], names)


def lexicon_of(words: DataFrame, matrix: np.ndarray, classes: dict[str, CharClass], ranges, unknown: dict[str, list[Entry]], user: DataFrame | None = None, most: int = 5_000_000) -> Lexicon:
    """A Lexicon from (surface, left, right, cost, feature) rows; more than `most` of them are an error, as every worker holds it."""

    def by_surface(df: DataFrame | None) -> dict[str, list[Entry]]:
        out: dict[str, list[Entry]] = {}
        if df is None:
            return out
        if df.limit(most + 1).count() > most:
            raise ValueError(f"a lexicon has at most {most} entries")
        for r in df.orderBy("surface", "cost", "left", "right", "feature").collect():
            out.setdefault(r.surface, []).append(Entry(r.left, r.right, r.cost, r.feature))
        return out

    return Lexicon(by_surface(words), matrix, classes, ranges, unknown, by_surface(user))
