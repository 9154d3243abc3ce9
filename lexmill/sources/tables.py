"""Loading the engine's tables: appends, replacements by staging, and what load files do to values."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.schema import TABLES


def blank_as_null(df: DataFrame) -> DataFrame:
    """Empty strings as null, as a load file can't tell them apart."""
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes])


def conformed(df: DataFrame, table: str) -> DataFrame:
    """The columns of the table, in order and of its types; further ones are left out."""
    return df.select(*[F.col(f"`{c.split()[0]}`").cast(c.split()[1]).alias(c.split()[0]) for c in TABLES[table].split(", ")])


def append(df: DataFrame, folder: str, table: str) -> None:
    """Add rows; none is no change."""
    blank_as_null(conformed(df, table)).write.mode("append").parquet(f"{folder}/{table}")


def replace(df: DataFrame, folder: str, table: str) -> None:
    """Write rows aside, then put them in the table's place: readers see the old table or the new one."""
    spark = df.sparkSession
    target, aside, old = f"{folder}/{table}", f"{folder}/_new_{table}_{uuid.uuid4().hex}", f"{folder}/_old_{table}_{uuid.uuid4().hex}"
    blank_as_null(conformed(df, table)).write.parquet(aside)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path(target)):
        fs.rename(path(target), path(old))
    if not fs.rename(path(aside), path(target)):
        raise OSError(f"{aside} could not be put in place of {target}")
    fs.delete(path(old), True)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{folder}/{table}")


def is_loaded(df: DataFrame, condition: str = "true") -> bool:
    """True if there is any row that meets the condition."""
    return bool(df.where(condition).limit(1).count())


def defs_as_json(defs: DataFrame) -> DataFrame:
    """Definitions with contents and tags as JSON texts, for stores without nested types."""
    return defs.withColumn("tags", F.to_json("tags"))
