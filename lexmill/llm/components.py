"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.storage import written


def stars(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) for each node a that isn't its component's least, b being that least node.

    edges has two long columns a and b; self-loops and repeated edges do no harm. Each round halves the
    depth of what is left and is written to the shared folder; no node's neighbours meet in one row, and
    only their least (aggregated before the shuffle) is looked up.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        inner = e.join(least.select(F.col("a").alias("b"), "m"), "b", "left_semi").limit(1).count()
        several = inner or e.groupBy("a").count().where("count > 1").limit(1).count()
        if not several:
            return e
        large = e.join(least.select(F.col("a").alias("b"), "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        e = written(small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), name)
