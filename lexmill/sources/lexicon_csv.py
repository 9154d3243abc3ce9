"""Lexicons as CSV: full feature files, name lists, word costs, connection costs, character readings."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import null_if_blank

#: The features of a word, in the order of the file, after its first four fields.
FEATURES = [
    "main_pos", "second_pos", "third_pos", "fourth_pos", "conj_type", "conj_form", "lemma_kata_rdg", "lemma", "orth_form", "pron", "orth_base",
    "pron_base", "goshu", "init_change_type", "init_change_form", "final_change_type", "final_change_form", "init_con_type", "final_con_type",
    "morph_type", "kana_repr", "kana_base", "form_form", "form_base", "accent_type", "accent_con_type", "accent_mod_type", "lemma_guid", "lemma_id",
]
# Main parts of speech, as files write them and as they are stored.
MAIN_POS = {
    "名詞": "Meishi", "動詞": "Doushi", "副詞": "Fukushi", "助動詞": "Jodoushi", "助詞": "Joshi", "形容詞": "Keiyoushi", "形状詞": "Keijoushi", "連体詞": "Rentaishi",
    "接尾辞": "Setsubiji", "補助記号": "Hojokigou", "記号": "Kigou", "代名詞": "Daimeishi", "感動詞": "Kandoushi", "接続詞": "Setsubishi", "接頭辞": "Settouji", "空白": "Kuuhaku",
}
# Connection classes and features of the three kinds of names.
NAMES = {"Myou": (357, 14993, "名詞,普通名詞,人名,名"), "Sei": (2793, 11570, "名詞,普通名詞,人名,姓"), "Noun": (6812, 546, "名詞,普通名詞,一般,*")}
NAME_COST, FIRST_NAME_ID = 5000, 400_000


def _csv(spark: SparkSession, path: str, columns: list[str], **options):
    return spark.read.csv(path, schema=", ".join(f"`{c}` string" for c in columns), header=False, quote='"', escape='"', **options)


def read_terms(spark: SparkSession, path: str, comes_from: str = "lexicon") -> DataFrame:
    """FEATURES of each row, '*' and empty as null, with row_no (from 1, in file order) and comes_from.

    Row numbers follow the files' order: of one file, the place of the row.
    """
    rows = _csv(spark, path, ["_1", "_2", "_3", "_4", *FEATURES]).drop("_1", "_2", "_3", "_4")
    numbered = rows.select(*[null_if_blank(c).alias(c) for c in FEATURES[:-2]], F.col("lemma_guid").cast("long").alias("lemma_guid"), F.col("lemma_id").cast("long").alias("lemma_id"), (F.monotonically_increasing_id() + 1).alias("row_no"))
    return numbered.withColumn("main_pos", stored_pos("main_pos")).withColumn("comes_from", F.lit(comes_from))


def stored_pos(column: str):
    """The stored name of a main part of speech; names that are stored already stay."""
    names = F.create_map(*[F.lit(x) for pair in MAIN_POS.items() for x in pair])
    return F.coalesce(names[F.col(column)], F.col(column))


def all_terms(lexicon: DataFrame, user: DataFrame) -> DataFrame:
    """Both, the user's after the lexicon's."""
    last = lexicon.agg(F.coalesce(F.max("row_no"), F.lit(0)).alias("last"))  # one row
    later = user.crossJoin(F.broadcast(last)).withColumn("row_no", F.col("row_no") + F.col("last")).drop("last")
    return lexicon.unionByName(later)


def name_entries(spark: SparkSession, path: str) -> DataFrame:
    """(surface, left, right, cost, number, feature) of a CSV of kind (Myou, Sei, Noun), surface, katakana reading."""
    rows = _csv(spark, path, ["kind", "surface", "reading"]).withColumn("number", F.monotonically_increasing_id())
    pick = lambda i: F.coalesce(*[F.when(F.col("kind") == k, F.lit(v[i])) for k, v in NAMES.items()])
    r, s = F.col("reading"), F.col("surface")
    tail = (F.col("number") + FIRST_NAME_ID).cast("string")
    feature = F.concat_ws(",", pick(2), F.lit("*,*"), r, s, s, r, s, r, F.lit("漢,*,*,*,*,*,*,体"), r, r, r, r, F.lit("*,*,*"), tail, tail)
    return rows.select("surface", pick(0).alias("left"), pick(1).alias("right"), F.lit(NAME_COST).alias("cost"), "number", feature.alias("feature")).where("left is not null")


def word_costs(spark: SparkSession, path: str) -> DataFrame:
    """(surface, left, right, cost, feature) of lines `surface,left,right,cost,feature...`; other lines are skipped."""
    m = r"^([^,]+),(\d+),(\d+),(-?\d+),(.*)$"
    part = lambda i: F.regexp_extract("value", m, i)
    return spark.read.text(path).where(F.col("value").rlike(m)).select(part(1).alias("surface"), part(2).cast("int").alias("left"), part(3).cast("int").alias("right"), part(4).cast("long").alias("cost"), part(5).alias("feature"))


def connection_costs(lines: list[str]) -> np.ndarray:
    """The matrix of a text whose first line has its shape, and each other one right class, left class, cost."""
    rights, lefts = map(int, lines[0].split())
    matrix = np.zeros((rights, lefts), np.int16)
    for line in lines[1:]:
        if line.strip():
            right, left, cost = map(int, line.split())
            matrix[right, left] = cost
    return matrix


def character_readings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """A JSON object of readings by character; a bounded resource (there are about 100,000 ideographs)."""
    text = spark.read.text(path, wholetext=True).first()
    return json.loads(text.value) if text else {}
