"""The queries opN_<name> over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import ann, bm25, bpe, ngram, packing, pii, quality, simhash, substring, toxicity
from lexmill.llm.labelled import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_texts(table(spark, sf_dir, "documents"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op8_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(table(spark, sf_dir, "documents"), "k % 50 = 0")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold("k") % 3 != 1)
    return quality.score(docs, model).withColumn("held_out", fold() % 3 == 1).select("doc_id", "held_out", "score", "predicted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("k") % 5 != 0)
    return toxicity.score(docs, model).withColumn("held_out", fold() % 5 == 0).select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_lm_score": op2_lm_score,
    "op3_substring": op3_substring,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_ann": op7_ann,
    "op8_bm25": op8_bm25,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
}

_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL: dict[str, str] = {
    "op3_substring": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
        starts AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, unnest(list_transform(range(1, len(ws) - 18), lambda i: hash(ws[i : i + 19]))) AS h FROM w WHERE len(ws) >= 20),
        windows AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM starts),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM windows WHERE nth > 1),
        words AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM w),
        kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, len(w.ws) AS n_words, len(w.ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op8_bm25": f"""
        WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD})) AS w
            FROM documents WHERE doc_id IS NOT NULL),
        tf AS (SELECT doc_id, w, count(*) AS tf FROM words GROUP BY doc_id, w),
        long AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
        df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
        corpus AS (SELECT count(*) AS n, (SELECT sum(n) FROM long) / count(*) AS mean FROM documents WHERE doc_id IS NOT NULL),
        hits AS (SELECT q.doc_id AS query_id, tf.doc_id, round(sum(ln(1 + (corpus.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * long.n / corpus.mean))), 9) AS score
            FROM tf AS q JOIN tf ON q.w = tf.w AND q.doc_id <> tf.doc_id JOIN df ON df.w = tf.w JOIN long ON long.doc_id = tf.doc_id CROSS JOIN corpus
            WHERE q.doc_id % 50 = 0 GROUP BY ALL),
        best AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM hits WHERE score > 0)
        SELECT query_id, rank, doc_id, score FROM best WHERE rank <= 10""",
}
