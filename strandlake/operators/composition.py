"""Base and quality frequencies of sequence tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the first character of the quality scale.
QUALITY_ZERO = 33


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(256, np.int64)
    for batch in batches:
        column = pc.drop_null(batch.column(0)).cast(pa.large_binary())
        _, offset_buffer, data = column.buffers()
        if len(column) == 0 or data is None:
            continue
        offsets = np.frombuffer(offset_buffer, np.int64)[column.offset:column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
        totals += np.bincount(raw, minlength=256)
    seen = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen.astype(np.int32)), pa.array(totals[seen])], ["value", "n"]
    )


def byte_counts(df: DataFrame, column: str) -> DataFrame:
    """``(value, n)``: occurrences of each byte value. Each task sends on at most 256 rows."""
    partial = df.select(column).mapInArrow(_count_bytes, "value int, n bigint")
    return partial.groupBy("value").agg(F.sum("n").alias("n"))


def _percent(n: Column) -> Column:
    return n * 100.0 / F.sum(n).over(Window.partitionBy())


def base_composition(df: DataFrame, column: str = "seq") -> DataFrame:
    """``(base, n, pct)`` per printable character; the rest is pooled as ``unprintable``."""
    printable = F.col("value").between(32, 126)
    base = F.when(printable, F.char(F.col("value").cast("bigint"))).otherwise("unprintable")
    counts = byte_counts(df, column).groupBy(base.alias("base")).agg(F.sum("n").alias("n"))
    return counts.select("base", "n", _percent(F.col("n")).alias("pct"))


def quality_composition(df: DataFrame, column: str = "qual") -> DataFrame:
    """``(quality, n, pct)``."""
    counts = byte_counts(df, column)
    return counts.select(
        (F.col("value") - QUALITY_ZERO).alias("quality"), "n", _percent(F.col("n")).alias("pct")
    )


def length_summary(df: DataFrame, column: str = "seq") -> DataFrame:
    size = F.octet_length(column).cast("bigint")
    return df.agg(
        F.count("*").alias("n_seq"), F.sum(size).alias("total"), F.avg(size).alias("average")
    )
