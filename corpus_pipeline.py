"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the
next one; all but the last return the columns of `documents`. No table needs to fit into one machine.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import packing, pii, quality, simhash, substring
from lexmill.llm.storage import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Fingerprints are candidates within so many bits, which finds nearly all texts whose five-word shingles are alike by SIMILARITY.
NEAR_BITS, SIMILARITY = 12, 0.8


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, takes for good.

    Null text is scored as the empty text, null ids and repeated rows each for themselves. An empty table gives an empty
    result; columns other than COLUMNS are dropped.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    scored = quality.score(docs, model, carry=[c for c in COLUMNS if c != "doc_id"])
    return scored.where("predicted = 1").select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row of smallest id; rows that repeat an id and text once; rows without id stay.

    A row is told by its id and text, so an id may come with several texts. Null text is the empty text. An empty table
    gives an empty result; columns other than COLUMNS are dropped.
    """
    member = simhash.near_duplicates(docs, limit=NEAR_BITS, at_least=SIMILARITY, with_kept=True)
    gone = member.where("doc_id is not null and not kept").select("doc_id", "text_hash").distinct()
    rows = docs.select(*COLUMNS, F.expr("xxhash64(coalesce(text, ''))").alias("text_hash"))
    return rows.join(gone, ["doc_id", "text_hash"], "left_anti").dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words and more that also start earlier in the corpus.

    Null text becomes the empty text; rows of null id count as one document before all others, rows that repeat an id as
    one document. An empty table gives an empty result; columns other than COLUMNS are dropped.
    """
    rest = substring.remove_repeats(docs, with_text=True, carry=["lang", "source"])
    rest = rest.select("doc_id", F.col("kept_text").alias("text"), "lang", "source")  # as it was, where nothing goes
    return rest.withColumn("n_chars", F.length("text").cast("long"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, and terms that disclose it, cut out or generalised.

    Null text stays null; null ids and repeated rows are rewritten each. An empty table gives an empty result; columns other
    than COLUMNS are dropped.
    """
    return pii.sanitise(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    Null text is the empty text (one end token); null ids stay null and repeated rows are packed each. An empty table
    gives an empty result; columns other than doc_id and text are dropped.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_quality),
    ("near-duplicates", without_near_duplicates),
    ("repeated passages", without_repeated_passages),
    ("personal data", without_personal_data),
    ("packing", packed),
]
#: Neither the classifier nor the tokenizer can be put into SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
