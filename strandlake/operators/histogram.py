"""Histograms with cumulative fractions and percentile summaries.

A histogram of depths or sizes has at most sqrt(2 * mass) distinct bins (distinct bins sum to no
more than the mass they count), so ordering its bins in one window is safe at any input size. ``dense`` adds
empty bins and is for display: sums run over the bins that occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str) -> DataFrame:
    """``(bin, n)`` for each value that occurs."""
    return df.groupBy(F.col(value).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def dense(hist: DataFrame) -> DataFrame:
    """Fill empty bins from 0 to the largest with ``n = 0``."""
    top = hist.agg(F.max("bin")).first()[0]
    bins = hist.sparkSession.range(0, 0 if top is None else top + 1).toDF("bin")
    return bins.join(hist, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def with_dummy_zero(hist: DataFrame) -> DataFrame:
    """Count one extra entry in bin 0, for parity with tables whose entry 0 is unused."""
    zero = hist.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("bin"), F.lit(1).cast("bigint").alias("n"))
    return hist.unionByName(zero).groupBy("bin").agg(F.sum("n").alias("n"))


def cumulative(hist: DataFrame) -> DataFrame:
    """Add the running fraction of the count and of the mass (bin times count)."""
    up_to = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mass = F.col("bin") * F.col("n")
    return hist.select(
        "bin",
        "n",
        F.sum("n").over(up_to).alias("cum_n"),
        F.sum(mass).over(up_to).alias("cum_mass"),
        F.sum("n").over(whole).alias("total_n"),
        F.sum(mass).over(whole).alias("total_mass"),
    ).select(
        "bin",
        "n",
        (F.col("cum_n") / F.col("total_n")).alias("cum_frac"),
        F.try_divide(F.col("cum_mass").cast("double"), F.col("total_mass")).alias("cum_mass_frac"),
        "cum_n",
        "cum_mass",
        "total_n",
        "total_mass",
    )


def summary(hist: DataFrame, skip_zero_bin: bool = False) -> DataFrame:
    """One row: mean, mode, median, 99th percentile, and their mass-weighted forms (N50, N99).

    A percentile is the first bin whose running count passes the truncated share of the total.
    ``skip_zero_bin`` keeps bin 0 from being a percentile. Ties of a mode go to the lowest bin.
    """
    mass = F.col("bin") * F.col("n")
    candidate = F.col("bin") > 0 if skip_zero_bin else F.lit(True)

    def first_past(running: str, total: str, share: float):
        limit = F.floor(F.col(total) * F.lit(share))
        return F.min(F.when((F.col(running) > limit) & candidate, F.col("bin")))

    return cumulative(hist).agg(
        F.max("total_n").alias("total_n"),
        F.max("total_mass").alias("total_mass"),
        F.try_divide(F.max("total_mass").cast("double"), F.max("total_n")).alias("mean"),
        F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))).alias("mode"),
        first_past("cum_n", "total_n", 0.5).alias("median"),
        first_past("cum_n", "total_n", 0.99).alias("percent99"),
        F.max_by("bin", F.struct(mass, -F.col("bin"))).alias("mass_mode"),
        first_past("cum_mass", "total_mass", 0.5).alias("n50"),
        first_past("cum_mass", "total_mass", 0.99).alias("n99"),
    )
