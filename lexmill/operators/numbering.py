"""Consecutive numbers over a distributed table."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order_by: list[str], name: str = "n", start: int = 1) -> DataFrame:
    """df with numbers from `start` in the given order, which must be total to be repeatable.

    Rows are dealt out by ranges and numbered within them; only the ranges' sizes come together.
    """
    dealt = df.repartitionByRange(*order_by).withColumn("_part", F.spark_partition_id())
    within = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order_by)))
    sizes = sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect())  # a row per partition
    before = list(zip([p for p, _ in sizes], accumulate([0, *[n for _, n in sizes][:-1]]) if sizes else []))
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before long")
    return within.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") + (start - 1)).drop("_part", "_at", "_before")


def with_new_ids(new: DataFrame, existing: DataFrame, order_by: list[str], name: str = "doc_id") -> DataFrame:
    """New rows numbered on from the greatest id there is."""
    last = existing.agg(F.max(name)).first()[0]
    return numbered(new, order_by, name, (last or 0) + 1)
