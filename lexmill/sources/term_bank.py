"""Dictionaries as term banks: JSON arrays of entries, in files term_bank_*.json of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lexmill.functions.text import katakana_to_hiragana

#: A dictionary whose entries are one text each, a heading and definitions on lines of their own.
ONE_TEXT = "旺文社"
# Fixed patterns of those texts.
HEADING = r"^([^【]+)?(【(.+)】)?([^（]+)?(（(.+)）)?(《(.+)》)?$"
DEFINITION = r"^(.+?)(「.+」)?$"


class NoTermBankFiles(FileNotFoundError):
    pass


def words_of(text: Column) -> Column:
    """Space-separated words, without empty ones."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def entries(texts: DataFrame, column: str = "value") -> DataFrame:
    """(entry, fields): each array in each JSON text, its elements as JSON or plain strings."""
    rows = texts.select(F.explode(F.from_json(column, "array<array<string>>", {"mode": "FAILFAST"})).alias("f"))
    return rows


def read_definitions(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(dict_name, spelling, reading, tags, contents) of the bank in a folder; NoTermBankFiles if there is no file.

    Entries are [spelling, reading, tags, rules, score, [content...], number, term tags]. An empty reading
    is the spelling; readings are in hiragana; entries without spelling are left out.
    """
    try:
        texts = spark.read.text(f"{path}/term_bank_*.json", wholetext=True)
    except AnalysisException as missing:
        raise NoTermBankFiles(path) from missing
    return definitions(texts, name)


def definitions(texts: DataFrame, name: str, column: str = "value") -> DataFrame:
    return decoded(entries(texts, column), name)


def decoded(rows: DataFrame, name: str, *carry: str) -> DataFrame:
    """Definitions of rows with an entry's fields (f); columns named in carry come along."""
    f = F.col("f")
    reading = F.when(f[1] == "", f[0]).otherwise(f[1])
    return rows.where(f[0] != "").select(*carry, F.lit(name).alias("dict_name"), f[0].alias("spelling"), katakana_to_hiragana(reading).alias("reading"), words_of(f[2]).alias("tags"), F.from_json(f[5], "array<string>").alias("contents"))


def parsed(text: Column) -> Column:
    """A one-text entry as a struct: plain lines if the heading doesn't parse, else its parts and definitions.

    Parts that are absent are null. A definition is its text and the examples in brackets behind it, if any.
    """
    lines = F.split(text, "\n", -1)
    head = F.element_at(lines, 1)
    part = lambda n: F.nullif(F.regexp_extract(head, HEADING, n), F.lit(""))
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    each = lambda d: F.struct(F.when(d.rlike(DEFINITION), F.regexp_extract(d, DEFINITION, 1)).otherwise(d).alias("definition"), F.nullif(F.regexp_extract(d, DEFINITION, 2), F.lit("")).alias("examples"))
    fits = head.rlike(HEADING)
    return F.struct(
        F.when(~fits, lines).alias("plain"), F.when(fits, part(3)).alias("spelling"), F.when(fits, part(1)).alias("reading"), F.when(fits, part(4)).alias("old_kana_spelling"),
        F.when(fits, part(6)).alias("conjugation_type"), F.when(fits, part(8)).alias("conjugation"), F.when(fits, F.transform(rest, each)).alias("definitions"),
    )


def with_content(defs: DataFrame) -> DataFrame:
    """definitions() with `content` as JSON: that of ONE_TEXT's entries parsed, other contents as they are."""
    plain = F.to_json("contents")
    return defs.withColumn("content", F.when(F.col("dict_name") == ONE_TEXT, F.to_json(parsed(F.element_at("contents", 1)))).otherwise(plain))


def frequencies(texts: DataFrame, column: str = "value") -> DataFrame:
    """(spelling, reading, frequency) of [spelling, kind, {reading, frequency}] entries; those with a bare number are left out."""
    rows = entries(texts, column).select(F.col("f")[0].alias("spelling"), F.from_json(F.col("f")[2], "reading string, frequency long").alias("b"))
    return rows.where("b.reading is not null and b.frequency is not null").select("spelling", "b.reading", "b.frequency")


def missing_dictionaries(wanted: DataFrame, defs: DataFrame) -> DataFrame:
    """Of wanted (dict_name, ...), those that defs has nothing of yet."""
    return wanted.join(defs.select("dict_name").distinct(), "dict_name", "left_anti")
