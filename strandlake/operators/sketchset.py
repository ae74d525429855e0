"""Sketch sets: tables ``(hash, depth, copy)`` with one row per hash, and their algebra."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import dna_text
from ..spec import HashSpec, SKETCH_SPEC
from .histogram import histogram
from .sketch import sketch

# Bases of barcode plus spacer at the start of a linked read.
BARCODE_BASES = 16
SPACER_BASES = 7
LINKED_PREFIX = BARCODE_BASES + SPACER_BASES


def count_hits(hits: DataFrame) -> DataFrame:
    """Sketch set of a hit table; the count is combined map-side, so a hot hash costs one row per task."""
    return hits.groupBy("hash").agg(
        F.count("*").alias("depth"), F.lit(0).cast("tinyint").alias("copy")
    )


def count_sequences(
    seqs: DataFrame, seq: str = "seq", spec: HashSpec = SKETCH_SPEC
) -> DataFrame:
    return count_hits(sketch(seqs, [], seq, spec))


def trim_linked_prefix(seqs: DataFrame, first_of_pair: Column, seq: str = "seq") -> DataFrame:
    """Drop barcode and spacer from the records that ``first_of_pair`` selects."""
    trimmed = F.when(first_of_pair, F.expr(f"substring(`{seq}`, {LINKED_PREFIX + 1})"))
    return seqs.withColumn(seq, trimmed.otherwise(F.col(seq)))


def input_totals(seqs: DataFrame, seq: str = "seq", spec: HashSpec = SKETCH_SPEC) -> DataFrame:
    """Sequences, bases and sampled hits of an input, in one pass."""
    from ..functions.sampling import sketch_udf

    sized = seqs.select(F.length(seq).alias("len"), F.size(sketch_udf(spec)(F.col(seq))).alias("n"))
    return sized.agg(
        F.count("*").alias("n_seq"),
        F.sum(F.col("len").cast("bigint")).alias("total_len"),
        F.sum(F.col("n").cast("bigint")).alias("total_hash"),
    )


def clean(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    return seqs.withColumn(seq, dna_text(F.col(seq)))


def prune(sketch_set: DataFrame, min_depth: int, max_depth: int = 0) -> DataFrame:
    """Keep ``min_depth <= depth < max_depth``; a ``max_depth`` of 0 means no upper bound."""
    kept = sketch_set.where(F.col("depth") >= min_depth)
    return kept.where(F.col("depth") < max_depth) if max_depth else kept


def set_copy(sketch_set: DataFrame, copy1_min: int, copy2_min: int, multi_min: int) -> DataFrame:
    """Copy class from depth: 0 below ``copy1_min``, then 1, 2 and, from ``multi_min`` on, 3."""
    copy = (
        F.when(F.col("depth") < copy1_min, 0)
        .when(F.col("depth") < copy2_min, 1)
        .when(F.col("depth") < multi_min, 2)
        .otherwise(3)
    )
    return sketch_set.withColumn("copy", copy.cast("tinyint"))


def set_copy_multi(sketch_set: DataFrame, multi_min: int) -> DataFrame:
    """Mark hashes of depth ``multi_min`` and more as multi-copy; the rest keep their class."""
    copy = F.when(F.col("depth") >= multi_min, F.lit(3).cast("tinyint")).otherwise(F.col("copy"))
    return sketch_set.withColumn("copy", copy)


def _check(specs: Sequence[HashSpec]) -> None:
    if any(not specs[0].compatible(other) for other in specs[1:]):
        raise ValueError("sketch sets with different hash settings cannot be combined")


def merge(
    left: DataFrame,
    right: DataFrame,
    specs: Sequence[HashSpec] = (SKETCH_SPEC,),
    copy_mode: str = "additive",
) -> DataFrame:
    """Union with added depths and copy classes; classes stop at 3.

    ``copy_mode="compat"`` ORs the left class with the sum, up to 3, instead of replacing it.
    """
    _check(specs)
    if copy_mode not in ("additive", "compat"):
        raise ValueError(f"unknown copy mode {copy_mode!r}")
    columns = [F.col("hash"), F.col("depth").cast("bigint"), F.col("copy").cast("int")]
    both = left.select(*columns, F.lit(True).alias("is_left")).unionByName(
        right.select(*columns, F.lit(False).alias("is_left"))
    )
    copy = F.least(F.sum("copy"), F.lit(3))
    if copy_mode == "compat":
        copy = copy.bitwiseOR(F.sum(F.when(F.col("is_left"), F.col("copy")).otherwise(0)))
    return both.groupBy("hash").agg(
        F.sum(F.col("depth").cast("bigint")).alias("depth"), copy.cast("tinyint").alias("copy")
    )


def merge_all(
    sets: Sequence[DataFrame], specs: Sequence[HashSpec] = (SKETCH_SPEC,)
) -> DataFrame:
    """Additive merge of any number of sets in one shuffle."""
    _check(specs)
    rows = reduce(DataFrame.unionByName, [s.select("hash", "depth", "copy") for s in sets])
    return rows.groupBy("hash").agg(
        F.sum(F.col("depth").cast("bigint")).alias("depth"),
        F.least(F.sum("copy"), F.lit(3)).cast("tinyint").alias("copy"),
    )


def depth_report(
    main: DataFrame, others: dict[str, DataFrame], hexadecimal: bool = True
) -> DataFrame:
    """Every hash of ``main`` with its depth there and in each other set (0 where absent).

    The sets are stacked and pivoted by one aggregation: one shuffle however many there are.
    """
    stacked = main.select("hash", "depth", F.col("copy").alias("copy"), F.lit(0).alias("src"))
    for i, other in enumerate(others.values(), start=1):
        stacked = stacked.unionByName(
            other.select("hash", "depth", F.lit(None).cast("tinyint").alias("copy"), F.lit(i).alias("src"))
        )

    def depth_in(i: int) -> Column:
        return F.max(F.when(F.col("src") == i, F.col("depth")))

    wide = stacked.groupBy("hash").agg(
        F.max("copy").alias("copy"),
        depth_in(0).alias("depth"),
        *[
            F.coalesce(depth_in(i), F.lit(0)).alias(f"depth_{name}")
            for i, name in enumerate(others, start=1)
        ],
    ).where(F.col("depth").isNotNull())
    if hexadecimal:
        wide = wide.withColumn("hash", F.lower(F.hex("hash")))
    return wide


def depth_histogram(sketch_set: DataFrame) -> DataFrame:
    return histogram(sketch_set, "depth").select(F.col("bin").alias("depth"), "n")


def set_summary(sketch_set: DataFrame) -> DataFrame:
    """One row: entries, total count, mean depth, N50 depth and hashes per copy class.

    The set is reduced to its ``(depth, copy)`` counts first; N50 is the first depth at which the
    running mass passes half of the total.
    """
    bins = sketch_set.groupBy("depth").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("copy") == c).alias(f"copy{c}") for c in range(4)],
    )
    mass = F.col("depth").cast("bigint") * F.col("n")
    order = Window.orderBy("depth")
    running = bins.select(
        "*",
        mass.alias("mass"),
        F.sum(mass).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
        F.sum(mass)
        .over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("total"),
    )
    return running.agg(
        F.sum("n").alias("n_entries"),
        F.sum("mass").alias("total_count"),
        F.try_divide(F.sum("mass").cast("double"), F.sum("n")).alias("avg_depth"),
        F.min(F.when(F.col("cum") > F.floor(F.col("total") / 2), F.col("depth"))).alias("n50_depth"),
        F.sum("copy0").alias("copy0"),
        F.sum("copy1").alias("copy1"),
        F.sum("copy2").alias("copy2"),
        F.sum("copy3").alias("copy_multi"),
    )
