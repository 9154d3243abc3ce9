"""Checks that tables keep their keys and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.schema import KEYS, REFERENCES


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that several rows have."""
    return df.groupBy(*key).count().where("count > 1")


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Rows of child whose reference (null: none) isn't in parent."""
    p = parent.select(*[F.col(b).alias(a) for a, b in zip(columns, parent_columns)]).distinct()
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return child.where(there).join(p, columns, "left_anti")


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """(check_name, violations), a row for every key and reference of the given tables."""
    parts = [repeated_keys(tables[t], key).agg(F.lit(f"{t} key {','.join(key)}").alias("check_name"), F.count("*").alias("violations")) for t in tables for key in KEYS.get(t, [])]
    parts += [orphans(tables[c], cc, tables[p], pc).agg(F.lit(f"{c} {','.join(cc)} in {p}").alias("check_name"), F.count("*").alias("violations")) for c, cc, p, pc in REFERENCES if c in tables and p in tables]
    return reduce(DataFrame.unionByName, parts)
