"""Truth classes of hashes from two known genomes of a diploid sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .incidence import CRIB_TYPES

# Fixed value: positions are kept in units of 2**POSITION_BITS bases.
POSITION_BITS = 10


def genome_presence(genome_hits: DataFrame, depths: DataFrame) -> DataFrame:
    """Hits of one genome whose hash is known or unknown, and its sequences."""
    per_hash = genome_hits.groupBy("hash").agg(F.count("*").alias("n"))
    known = per_hash.join(depths.select("hash", F.lit(True).alias("known")), "hash", "left")
    hits = known.agg(
        F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("n_present"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("n_absent"),
    )
    chromosomes = genome_hits.select("chr").distinct().agg(F.count("*").alias("n_seq"))
    return hits.join(F.broadcast(chromosomes))


def build_crib(depths: DataFrame, genome_a: DataFrame, genome_b: DataFrame) -> DataFrame:
    """Class each known hash by its occurrences in two genomes given as ``(hash, chr, pos)`` hits.

    Absent from both is ``err``; once in each is ``hom``; repeated in either is ``mul``; once in
    exactly one is ``htA`` or ``htB``. ``chr`` is the sequence of a single hit and, for ``mul``, minus
    the number of repeats. All three inputs are stacked and meet in one aggregation, with chromosome and
    position in one number.
    """
    def side(hits: DataFrame, tag: str) -> DataFrame:
        return hits.select(
            "hash", F.lit(None).cast("bigint").alias("depth"), F.lit(tag).alias("src"),
            F.shiftleft(F.col("chr").cast("int").cast("bigint"), 32).bitwiseOR(F.col("pos").cast("int").cast("bigint")).alias("at"),
        )

    known = depths.select(
        "hash", F.col("depth").cast("bigint").alias("depth"), F.lit("k").alias("src"),
        F.lit(None).cast("bigint").alias("at"),
    )
    stacked = known.unionByName(side(genome_a, "a")).unionByName(side(genome_b, "b"))

    def per_genome(tag: str):
        mine = F.col("src") == tag
        return F.count_if(mine).alias(f"n_{tag}"), F.min(F.when(mine, F.col("at"))).alias(f"at_{tag}")

    merged = stacked.groupBy("hash").agg(
        F.max("depth").alias("depth"), *per_genome("a"), *per_genome("b")
    ).where(F.col("depth").isNotNull())

    n_a, n_b = F.col("n_a"), F.col("n_b")
    kind = (
        F.when((n_a == 0) & (n_b == 0), "err")
        .when((n_a == 1) & (n_b == 1), "hom")
        .when((n_a > 1) | (n_b > 1), "mul")
        .when(n_a == 1, "htA")
        .otherwise("htB")
    )
    def chr_of(at: str) -> Column:
        return F.shiftright(F.col(at), 32)

    def pos_of(at: str) -> Column:
        return F.col(at).bitwiseAND(F.lit((1 << 32) - 1))

    chrom = (
        F.when(F.col("type") == "err", 0)
        .when(F.col("type") == "mul", 1 - F.greatest(n_a, n_b))
        .when(F.col("type") == "htB", chr_of("at_b"))
        .otherwise(chr_of("at_a"))
    )
    place = F.when(F.col("type") == "htB", pos_of("at_b")).otherwise(pos_of("at_a"))
    return merged.withColumn("type", kind).select(
        "hash",
        "depth",
        "type",
        chrom.cast("int").alias("chr"),
        F.coalesce(F.shiftright(place, POSITION_BITS), F.lit(0)).cast("int").alias("pos"),
    )


def crib_table(crib: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Hashes per depth and class, up to ``max_depth`` if given; both heterozygous classes count as one."""
    kind = F.col("type")
    return (
        (crib if max_depth is None else crib.where(F.col("depth") <= max_depth))
        .groupBy("depth")
        .agg(
            F.count_if(kind == "err").alias("err"),
            F.count_if(kind.isin("htA", "htB")).alias("het"),
            F.count_if(kind == "hom").alias("hom"),
            F.count_if(kind == "mul").alias("mul"),
        )
    )


def crib_stats(crib: DataFrame) -> DataFrame:
    """Number of hashes and mean, least and largest depth per class."""
    group = F.when(F.col("type").isin("htA", "htB"), "het").otherwise(F.col("type"))
    return crib.groupBy(group.alias("class")).agg(
        F.count("*").alias("n"),
        F.avg("depth").alias("mean_depth"),
        F.min("depth").alias("min_depth"),
        F.max("depth").alias("max_depth"),
    )


def crib_summary(inc: DataFrame, crib: DataFrame, codes: DataFrame) -> DataFrame:
    """Per code kind (base, or split off a cluster) and class: rows, distinct hashes and their ratio.

    ``codes`` needs ``barcode`` and ``parent`` (NULL for a base code). Rows are first reduced to one
    per hash and kind, so the distinct count never sees a hot hash twice.
    """
    kinds = codes.select("barcode", F.col("parent").isNotNull().alias("is_cluster"))
    per_hash = (
        inc.join(kinds, "barcode").groupBy("is_cluster", "hash").agg(F.count("*").alias("n"))
    )
    return (
        per_hash.join(crib.select("hash", "type"), "hash")
        .groupBy("is_cluster", "type")
        .agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_hash"))
        .withColumn("ratio", F.col("n_rows") / F.col("n_hash"))
    )


__all__ = [
    "CRIB_TYPES", "build_crib", "crib_stats", "crib_summary", "crib_table", "genome_presence",
]
