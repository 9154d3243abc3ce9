"""Lemmas, variants and surface forms out of a lexicon's terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import katakana_to_hiragana, lemma_disambiguation, lemma_spelling, uuid_of

_POS = ["main_pos", "second_pos", "third_pos", "fourth_pos"]


def extracted(terms: DataFrame) -> DataFrame:
    """Each term's lemma, variant and surface form: spellings as they are, readings in hiragana."""
    return terms.select(
        "row_no", "lemma_id", "lemma_guid", "comes_from", *_POS, F.col("lemma").alias("lemma_spelling"), katakana_to_hiragana("lemma_kata_rdg").alias("lemma_reading"),
        F.col("orth_base").alias("variant_spelling"), katakana_to_hiragana("form_base").alias("variant_reading"), F.col("orth_form").alias("surface_spelling"), katakana_to_hiragana("kana_repr").alias("surface_reading"),
    )


def _first(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The row of least row_no of each key: an aggregate, so no key's rows come together."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), "row_no").alias("_r"), F.min("row_no").alias("first_row")).select(*keys, "first_row", "_r.*")


def lemmas(terms: DataFrame) -> DataFrame:
    """The first term of each lemma; its spelling ends at the first hyphen, and the rest tells it from others."""
    rows = _first(extracted(terms), ["lemma_id"], ["lemma_spelling", "lemma_reading", *_POS, "comes_from"])
    return rows.select(uuid_of("lemma_id").alias("lemma_id"), lemma_spelling("lemma_spelling").alias("spelling"), lemma_disambiguation("lemma_spelling").alias("disambiguation"), F.col("lemma_reading").alias("reading"), *_POS, "comes_from")


_VARIANT = ["lemma_id", "variant_spelling", "variant_reading"]


def _variant_rows(terms: DataFrame) -> DataFrame:
    return extracted(terms).groupBy(*_VARIANT).agg(F.min("row_no").alias("number"))


def variants(terms: DataFrame) -> DataFrame:
    """One per lemma, spelling and reading; numbered by the first term that has it."""
    return _variant_rows(terms).select(uuid_of("number").alias("variant_id"), uuid_of("lemma_id").alias("lemma_id"), F.col("variant_spelling").alias("spelling"), F.col("variant_reading").alias("reading"))


def surface_forms(terms: DataFrame) -> DataFrame:
    """The first term of each surface id, with its variant."""
    rows = _first(extracted(terms), ["lemma_guid"], [*_VARIANT, "surface_spelling", "surface_reading"]).alias("s")
    v = _variant_rows(terms).alias("v")
    same = F.col("s.lemma_id").eqNullSafe(F.col("v.lemma_id")) & F.col("s.variant_spelling").eqNullSafe(F.col("v.variant_spelling")) & F.col("s.variant_reading").eqNullSafe(F.col("v.variant_reading"))
    return rows.join(v, same).select(uuid_of("s.lemma_guid").alias("surface_form_id"), uuid_of("v.number").alias("variant_id"), F.col("s.surface_spelling").alias("spelling"), F.col("s.surface_reading").alias("reading"))
