"""Text files with record numbers that hold across file splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(
    spark: SparkSession, paths: str | Sequence[str], separator: str | None = None
) -> DataFrame:
    """``(file, in_file, seq_id, value)``: records with their 0-based number in the file and their
    1-based number over all files, in path order.

    Files stay splittable. Records of one split are consecutive within a task, so a record's number is
    its distance from the first record of the split plus the records of earlier splits; only one row
    per split is ordered.
    """
    reader = spark.read
    if separator is not None:
        reader = reader.option("lineSep", separator)
    rows = reader.text(paths if isinstance(paths, str) else list(paths)).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
    )
    splits = rows.groupBy("file", "block").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    earlier_here = (
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = splits.select(
        "file", "block", "first",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n").over(earlier_here), F.lit(0)).alias("file_base"),
    )
    distance = F.col("mid") - F.col("first")
    return rows.join(starts, ["file", "block"]).select(
        "file",
        (F.col("file_base") + distance).alias("in_file"),
        (F.col("base") + distance + 1).alias("seq_id"),
        "value",
    )
