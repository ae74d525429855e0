"""Barcodes of linked reads: frequent prefixes, whitelist correction, pairing of mates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import BASES
from ..functions.packing import switch_base
from . import skew

# Barcode length, and the reads that make a barcode good.
BARCODE_BASES = 16
GOOD_CODE_READS = 100


def raw_barcode(seq: Column) -> Column:
    """The first 16 bases; anything but ACGT counts as A."""
    return F.regexp_replace(F.upper(F.substring(seq, 1, BARCODE_BASES)), "[^ACGT]", "A")


def good_codes(reads: DataFrame, seq: str = "seq1", min_reads: int = GOOD_CODE_READS) -> DataFrame:
    """Prefixes of 16 bases that start at least ``min_reads`` reads."""
    prefix = F.substring(seq, 1, BARCODE_BASES).alias("barcode")
    counts = reads.where(F.length(seq) >= BARCODE_BASES).groupBy(prefix).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_reads)


def whitelist_variants(whitelist: DataFrame, exact_first: bool = True) -> DataFrame:
    """``(raw, barcode, fix_pos)``: every 16-mer within one mismatch of ``whitelist(line_no, barcode)``.

    A 16-mer near several barcodes goes to the one on the latest line. With ``exact_first`` a
    whitelisted 16-mer always stands for itself; ``fix_pos`` is then NULL.
    """
    spots = F.sequence(F.lit(0), F.lit(BARCODE_BASES - 1))
    own = F.substring("barcode", F.col("spot") + 1, F.lit(1))
    # a whitelist is one small file: deal it out before it grows to 49 rows per line
    cores = whitelist.sparkSession.sparkContext.defaultParallelism
    spread = (
        whitelist.select("line_no", F.col("barcode").cast("string").alias("barcode"))
        .repartition(cores, "line_no")
        .select("*", F.explode(spots).alias("spot"))
        .select("*", F.explode(F.array(*[F.lit(b) for b in BASES])).alias("base"))
        .where((F.col("base") != own) | (F.col("spot") == 0))
    )
    # One number ranks a variant (exact, line, spot) and tells which base the whitelist has at its spot.
    exact = (own == F.col("base")) & F.lit(exact_first)
    true_base = F.instr(F.lit(BASES), own) - 1
    rank = (
        F.when(exact, F.lit(1 << 62)).otherwise(F.lit(0)) + F.col("line_no") * 64
        + F.col("spot") * 4 + true_base
    )
    best = spread.groupBy(
        switch_base(F.col("barcode"), F.col("spot"), F.col("base")).alias("raw")
    ).agg(F.max(rank).alias("rank"))
    spot = F.floor(F.col("rank") % 64 / 4).cast("int")
    base = F.substring(F.lit(BASES), (F.col("rank") % 4 + 1).cast("int"), F.lit(1))
    found = best.select("raw", switch_base(F.col("raw"), spot, base).alias("barcode"), spot.alias("spot"))
    return found.select(
        "raw", "barcode", F.when(F.col("raw") != F.col("barcode"), F.col("spot")).alias("fix_pos")
    )


def correct_barcodes(reads: DataFrame, variants: DataFrame, seq: str = "seq1") -> DataFrame:
    """Reads whose barcode is in the whitelist or one mismatch away; ``barcode`` is the corrected one.

    Only barcodes that occur are looked up. A barcode that very many reads carry is cut into parts.
    """
    marked = reads.withColumn("raw", raw_barcode(F.col(seq)))
    counts = marked.groupBy("raw").agg(F.count("*").alias("n"))
    hot = skew.parts_of(counts, "raw", "n")
    found = skew.copied(_looked_up(counts.select("raw"), variants), hot, "raw")
    return skew.cut(marked, hot, "raw", *reads.columns).join(found, ["raw", "_part"]).drop("raw", "_part")


def _looked_up(raw: DataFrame, variants: DataFrame, how: str = "inner") -> DataFrame:
    """``raw(raw, ...)`` with its variant.

    A plan takes the variants for as small as the whitelist, of which they are 49 times the rows; the hint keeps them
    from being broadcast.
    """
    return raw.join(variants.hint("merge"), "raw", how)


def correction_counts(reads: DataFrame, variants: DataFrame, seq: str = "seq1") -> DataFrame:
    """One row: reads written, dropped and fixed, and fixes per base position.

    Reads are counted per raw barcode before the lookup.
    """
    raw = reads.groupBy(raw_barcode(F.col(seq)).alias("raw")).agg(F.count("*").alias("n"))
    looked_up = _looked_up(raw, variants, "left")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return looked_up.agg(
        total(F.col("barcode").isNotNull()).alias("n_written"),
        total(F.col("barcode").isNull()).alias("n_dropped"),
        total(F.col("fix_pos").isNotNull()).alias("n_fixed"),
        *[total(F.col("fix_pos") == i).alias(f"fixed_{i}") for i in range(BARCODE_BASES)],
    ).select(
        "*",
        F.try_divide(100.0 * F.col("n_dropped"), F.col("n_dropped") + F.col("n_written")).alias("pct_dropped"),
        F.try_divide(100.0 * F.col("n_fixed"), F.col("n_written")).alias("pct_fixed"),
    )


def pair_reads(first: DataFrame, second: DataFrame, on: str = "seq_id") -> DataFrame:
    """Join two mate tables ``(seq_id, name, seq, qual)`` by record number.

    A pair whose names differ is kept and marked; a first mate without a second is an error.
    """
    left = first.select(
        on, F.col("name").alias("name1"), F.col("seq").alias("seq1"), F.col("qual").alias("qual1")
    )
    right = second.select(
        on, F.col("name").alias("name2"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2")
    )
    joined = left.join(right, on, "left")
    early = F.raise_error(F.lit("the second file ended early"))
    seq2 = F.when(F.col("seq2").isNull(), early).otherwise(F.col("seq2"))
    return joined.withColumn("seq2", seq2).withColumn(
        "names_differ", ~F.col("name1").eqNullSafe(F.col("name2"))
    )
