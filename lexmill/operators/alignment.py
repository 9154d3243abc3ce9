"""Aligning a spelling with its reading, character by character."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.shared import shared
from lexmill.functions.text import HIRAGANA, KATAKANA

_FOLD = str.maketrans(KATAKANA, HIRAGANA)
_BLOCKS = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2EBE0), (0x2EBF0, 0x2EE5D), (0x30000, 0x323AF)]
_SINGLE = {0xFA0E, 0xFA0F, 0xFA11, 0xFA13, 0xFA14, 0xFA1F, 0xFA21, 0xFA23, 0xFA24, 0xFA27, 0xFA28, 0xFA29}
_WORD = re.compile("[○◯々-〇〻ぁ-ゖゝ-ゞァ-ヺーｦ-ﾝ⺀-⺙⺛-⻳⼀-⿕" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _BLOCKS) + "".join(map(chr, sorted(_SINGLE))) + "]+")
# Which kana of a dictionary's reading stand for which of a word's, and why.
_VOICED = {
    "か": "が", "き": "ぎ", "く": "ぐ", "け": "げ", "こ": "ご", "さ": "ざ", "し": "じ", "す": "ず", "せ": "ぜ", "そ": "ぞ",
    "た": "だ", "ち": "ぢじ", "つ": "づず", "て": "で", "と": "ど", "は": "ばぱ", "ひ": "びぴ", "ふ": "ぶぷ", "へ": "べぺ", "ほ": "ぼぽ",
}
_CLIPPED = {"つ": "っ", "く": "っ"}
_STEMS = {"る": "り", "む": "み", "く": "き", "す": "し", "つ": "ち"}
_OLD = {"お": "を", "わ": "は", "は": "わ", "ひ": "い"}
_VOWELS = "ぁぃぅぇぉあいうえお"
_GA = "けケ"
_SMALL = "っぁぃぅぇぉゃゅょ"


def is_ideograph(c: str) -> bool:
    return ord(c) in _SINGLE or any(a <= ord(c) <= b for a, b in _BLOCKS)


def kana_match(x: str, y: str, place: str = "middle") -> str | None:
    """How a dictionary's kana x stands for a word's kana y at the start, middle or end of a reading; None if it doesn't."""
    if place == "start" and y in _VOICED.get(x, ""):
        return "Voicing"
    if place == "end":
        if _CLIPPED.get(x) == y:
            return "Glottalisation"
        if _STEMS.get(x) == y:
            return "Stem"
    if x == "*":
        return "Wildcard"
    if _OLD.get(x) == y:
        return "OldKana"
    if y == "ー" and x in _VOWELS:
        return "LongVowelMark"
    if y == "が" and x in _GA:
        return "KatakanaGa"
    return "Identical" if x == y else None


def candidate_readings(readings: Sequence[str], longest: int) -> list[str]:
    """What a character may read as, best first: readings in full, stems and swallowed endings, then wildcards.

    In a reading, '-' marks an affix and '.' parts the stem from the ending that is spelt out.
    """
    full, more = [], []
    for r in readings:
        clean = r.replace("-", "").replace(".", "")
        if not clean:
            continue
        if clean.endswith("る"):
            more.append(clean.split("る", 1)[0])
        full.append(clean)
        if "." in r:
            stem, ending = (part.replace("-", "") for part in r.split(".", 1))
            ending = ending.replace(".", "")
            more += [stem + ending[:n] for n in range(len(ending) + 1)]
    ordered = sorted(full, key=len, reverse=True) + sorted(more, key=len, reverse=True) + ["*" * n for n in range(1, longest + 1)]
    return list(dict.fromkeys(ordered))


@dataclass(frozen=True)
class Span:
    kind: str  # kana or kanji
    spelling: str
    reading: str
    underlying: str
    matches: tuple[str, ...]


def annotate(spelling: str, reading: str, kanji: dict[str, Sequence[str]]) -> tuple[str, list[Span]]:
    """A status and, for Valid and Inconsistent, the spans.

    Invalid: the spelling isn't Japanese throughout. IterationMark: it begins with one. Unknown: nothing fits.
    Inconsistent: a character would have to be silent. The first fit is taken, by the order of
    candidate_readings() at each character; places that are known to lead nowhere aren't tried again.
    """
    if not _WORD.fullmatch(spelling):
        return "Invalid", []
    hopeless: set[tuple[int, int]] = set()
    # (place in spelling, place in reading, spans so far as a linked list)
    stack: list[tuple[int, int, tuple | None]] = [(0, 0, None)]
    while stack:
        o, p, path = stack.pop()
        if (o, p) in hopeless:
            continue
        hopeless.add((o, p))  # all that follows from here is tried now, once
        if o == len(spelling) and p == len(reading):
            spans: list[Span] = []
            while path:
                spans.append(path[0])
                path = path[1]
            return ("Inconsistent" if any(not s.reading for s in spans) else "Valid"), spans[::-1]
        if o == len(spelling) or p == len(reading):
            continue
        c = spelling[o]
        stands_for = c
        if c in "々ゝ":
            if o == 0:
                return "IterationMark", []
            stands_for = spelling[o - 1]
        if not is_ideograph(stands_for):
            heard = reading[p].translate(_FOLD)
            match = kana_match(stands_for.translate(_FOLD), heard)
            if match:
                stack.append((o + 1, p + 1, (Span("kana", c, heard, c, (match,)), path)))
            continue
        following = []
        for known in candidate_readings(kanji.get(stands_for, ()), len(reading)):
            part = reading[p : p + len(known)]
            if len(part) < len(known) or part and part[0] in _SMALL:
                continue
            last = len(known) - 1
            matches = [kana_match(x, y, "start" if i == 0 else "end" if i == last else "middle") for i, (x, y) in enumerate(zip(known, part.translate(_FOLD)))]
            if None not in matches:
                following.append((o + 1, p + len(known), (Span("kanji", c, part, known, tuple(matches)), path)))
        stack += following[::-1]
    return "Unknown", []


ANNOTATED = "status string, spans array<struct<kind:string,spelling:string,reading:string,underlying:string,match_kinds:array<string>>>"


def annotated(words: DataFrame, kanji: dict[str, Sequence[str]], id_col: str = "variant_id", spelling_col: str = "spelling", reading_col: str = "reading", most: int = 100_000) -> DataFrame:
    """(variant_id, status, spans) of every word; status is null where spelling or reading is null. kanji is a bounded resource.

    A spelling and reading met again isn't aligned again, as long as a worker remembers no more than about `most` of them.
    """
    resource = shared(words.sparkSession, kanji)
    struct = pa.struct([("kind", pa.string()), ("spelling", pa.string()), ("reading", pa.string()), ("underlying", pa.string()), ("match_kinds", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str | None, str | None], tuple] = {}
        for batch in batches:
            if len(known) > most:
                known.clear()
            pairs = list(zip(batch.column("s").to_pylist(), batch.column("r").to_pylist()))
            places = {pair: i for i, pair in enumerate(dict.fromkeys(pairs))}
            for s, r in places:
                if (s, r) not in known:
                    status, spans = annotate(s, r, resource()) if s is not None and r is not None else (None, None)
                    known[s, r] = status, spans and [{"kind": x.kind, "spelling": x.spelling, "reading": x.reading, "underlying": x.underlying, "match_kinds": list(x.matches)} for x in spans]
            found = [known[pair] for pair in places]
            ids = pa.array(list(map(places.__getitem__, pairs)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([f[0] for f in found], pa.string()).take(ids), pa.array([f[1] for f in found], pa.list_(struct)).take(ids)], ["variant_id", "status", "spans"])

    return words.selectExpr(f"cast(`{id_col}` as string) as k", f"`{spelling_col}` as s", f"`{reading_col}` as r").mapInArrow(run, f"variant_id string, {ANNOTATED}")


def morphemes(aligned: DataFrame) -> DataFrame:
    """(variant_id, morpheme_index, spelling, reading, underlying_reading) of the valid alignments, once each."""
    rows = aligned.where("status = 'Valid'").select("variant_id", F.posexplode("spans").alias("morpheme_index", "s"))
    return rows.select("variant_id", "morpheme_index", "s.spelling", "s.reading", F.col("s.underlying").alias("underlying_reading")).dropDuplicates()


def coverage(aligned: DataFrame) -> DataFrame:
    """(status, words, percent) over all words."""
    counts = aligned.groupBy(F.coalesce("status", F.lit("None")).alias("status")).agg(F.count("*").alias("words"))
    total = counts.agg(F.sum("words").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("status", "words", (F.col("words") * 100.0 / F.col("total")).alias("percent"))


def common_readings(aligned: DataFrame, least: int = 10) -> DataFrame:
    """(spelling, reading, times) of characters read alike at least so often, the commonest first."""
    rows = aligned.where("status = 'Valid'").select(F.explode("spans").alias("s")).where("s.kind = 'kanji'").groupBy(F.col("s.spelling").alias("spelling"), F.col("s.reading").alias("reading")).agg(F.count("*").alias("times"))
    return rows.where(F.col("times") >= least).orderBy(F.desc("times"), "spelling", "reading")
