"""Scalar text functions, all built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Katakana from U+30A1 to U+30F6 lie 0x60 above their hiragana.
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)
#: Unified ideographs by block, as Java's matcher has no class for them. The twelve of the compatibility block are single.
IDEOGRAPHS = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBE0}\x{2EBF0}-\x{2EE5D}\x{30000}-\x{323AF}\x{FA0E}\x{FA0F}\x{FA11}\x{FA13}\x{FA14}\x{FA1F}\x{FA21}\x{FA23}\x{FA24}\x{FA27}-\x{FA29}"
RADICALS = r"\x{2E80}-\x{2E99}\x{2E9B}-\x{2EF3}\x{2F00}-\x{2FD5}"
JAPANESE = rf"○◯々-〇〻ぁ-ゖゝ-ゞァ-ヺーｦ-ﾝ{RADICALS}{IDEOGRAPHS}"
#: What counts as punctuation when a text is laid out.
PUNCTUATION = ["「", "」", "。", "、", "？", "！", "　", "─", "）", "（", "…", "︙", "《", "》"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def katakana_to_hiragana(c: Column | str) -> Column:
    return F.translate(_col(c), KATAKANA, HIRAGANA)


def is_ideograph(c: Column | str) -> Column:
    """True if there is a unified ideograph in the string."""
    return _col(c).rlike(f"[{IDEOGRAPHS}]")


def is_japanese(c: Column | str) -> Column:
    return _col(c).rlike(f"^[{JAPANESE}]+$") & ~_col(c).endswith("\n")


def count_japanese(c: Column | str) -> Column:
    """How many characters are kana, ideographs, radicals or their marks."""
    return F.length(F.regexp_replace(_col(c), f"[^{JAPANESE}]", ""))


def is_punctuation(c: Column | str) -> Column:
    return _col(c).isin(PUNCTUATION)


def clean_title(c: Column | str, otherwise: Column | str) -> Column:
    """A book's title without what stands in brackets or between wave dashes, after a full stop or a wide space; `otherwise` for null."""
    cleaned = F.regexp_replace(_col(c), r"(～.+～)|(\(.+\))|(（.+）)|(【.+】)|(。.*$)|(　.*$)", "")
    return F.coalesce(cleaned, _col(otherwise))


def lemma_spelling(c: Column | str) -> Column:
    return F.substring_index(_col(c), "-", 1)


def lemma_disambiguation(c: Column | str) -> Column:
    """What follows the first hyphen; null without one."""
    return F.when(_col(c).contains("-"), F.regexp_extract(_col(c), r"(?s)^[^-]*-(.*)$", 1))


def null_if_blank(c: Column | str) -> Column:
    """Null for '*' and the empty string, which lexicon files write for a missing feature."""
    return F.when(~_col(c).isin("*", ""), _col(c))


def html_escape(c: Column | str) -> Column:
    out = _col(c)
    # the ampersand first; fixed values
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def joined(c: Column | str) -> Column:
    return F.array_join(_col(c), ", ")


def dictionary_language(c: Column | str) -> Column:
    return F.when(_col(c).contains("pixiv") | _col(c).contains("旺文社"), "ja").otherwise("en")


def uuid_of(c: Column | str) -> Column:
    """A 64-bit number as the low half of a UUID."""
    h = F.lower(F.lpad(F.hex(_col(c).cast("long")), 16, "0"))
    return F.concat(F.lit("00000000-0000-0000-"), F.substring(h, 1, 4), F.lit("-"), F.substring(h, 5, 12))


def normalised_path(c: Column | str) -> Column:
    """A relative path without '.' and '..' steps; a '..' takes the step before it, if there is one."""
    steps = F.filter(F.split(_col(c), "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)))
    return F.concat(F.when(_col(c).startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))
