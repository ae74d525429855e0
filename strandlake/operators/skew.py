"""Joins whose keys may be hot: measured hot keys are cut on one side and copied on the other.

``hot_keys`` counts first (tasks count before the shuffle), so that only keys above ``ROWS`` rows are touched; all
other rows stay whole. The list of hot keys has at most one row in ``ROWS`` of the input; adaptive execution broadcasts it
where it is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task joins.
ROWS = 10_000


def hot_keys(df: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """``(key, _parts)`` of the keys with more than ``rows`` rows."""
    return parts_of(df.groupBy(key).agg(F.count("*").alias("_n")), key, "_n", rows)


def parts_of(counts: DataFrame, key: str, n: str, rows: int = ROWS) -> DataFrame:
    """The same from ``counts(key, n)``."""
    return counts.where(F.col(n) > rows).select(key, F.ceil(F.col(n) / rows).cast("int").alias("_parts"))


def cut(df: DataFrame, hot: DataFrame, key: str, *by: str) -> DataFrame:
    """``df`` with ``_part``: rows of a hot key are dealt over its parts by ``by``; others are in part 0."""
    dealt = F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1)).cast("bigint")).cast("int")
    return df.join(hot, key, "left").withColumn("_part", dealt).drop("_parts")


def copied(df: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_part``: rows of a hot key once for each of its parts; others in part 0."""
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    return df.join(hot, key, "left").withColumn("_part", F.explode(parts)).drop("_parts")
