"""Ranks and running sums over a whole table, or within groups of any size, without a single-task sort.

Rows are dealt to ranges of the order whose bounds are sampled from the rows themselves, so outliers and frequent values do
not fill one range; the last columns of the order may cut even a group or a key that holds most rows. A row's place is that
within its range, plus the rows of its group in earlier ranges. Only the totals of ranges are summed up, at most one row for
each range and group. Orders are expected to be total; rows that tie in all of it stand in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _dealt(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with ``_part``, the number of the range of a row, and ``_at``, its place among all rows of the order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # written once, so that all that follows sees the same ranges; the id rises within a range
    return cut_lineage(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))


def _before(value: Column, by: Sequence[str]) -> Column:
    """The sum of ``value`` over the earlier ranges of the group."""
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0))


def grouped_rank(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: the number of a row, from 1, within its group ``by`` in the order ``order``."""
    rows = _dealt(df, [*by, *order])
    ranges = rows.groupBy("_part", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    ranges = ranges.select("_part", *by, (_before(F.col("_n"), by) + 1 - F.col("_first")).alias("_add")).withColumnRenamed("_part", "_range")
    same = F.col("_part") == F.col("_range")
    for column in by:
        ranges = ranges.withColumnRenamed(column, f"_{column}")
        same = same & F.col(column).eqNullSafe(F.col(f"_{column}"))
    return rows.join(ranges, same).select(*df.columns, (F.col("_at") + F.col("_add")).alias(name))


def running_sum(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows with a smaller ``key``. Keys are distinct."""
    rows = _dealt(df, [key])
    totals = rows.groupBy("_part").agg(F.sum(value).alias("_total"))
    totals = totals.select(F.col("_part").alias("_range"), _before(F.col("_total"), ()).alias("_add"))
    local = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
    return rows.join(totals, F.col("_part") == F.col("_range")).select(*df.columns, (F.col("_add") + F.col("_local")).alias(name))


def global_rank(df: DataFrame, key: str, tie_break: str, name: str) -> DataFrame:
    """Add ``name``: 1-based rank by ``key``, then by ``tie_break``."""
    return grouped_rank(df, (), (key, tie_break), name)
