"""Barcode-hash incidence: which barcode (code) carries which hash, seen first in which read.

``inc`` tables hold ``(barcode, hash, read)`` with one row per barcode and hash. Depth here is the
number of barcodes that carry a hash. The inverse list of a hash is the same table keyed by hash;
it is never gathered into one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..spec import HashSpec, LINKED_READ_SPEC
from . import histogram as hist
from . import skew
from .ranks import global_rank
from .sketch import sketch

# Fixed value: where the first mate of a linked read starts, behind barcode and spacer.
MATE1_START = 24

# Share counts up to LOW_SHARE carry no weight in the error score; hashes of a depth
# below MIN_SCORED_DEPTH are not scored; scores on the wrong side of SCORE_CUT are flagged.
LOW_SHARE = 3
MIN_SCORED_DEPTH = 5
SCORE_CUT = 0.00005

#: Pairs of a target and another hash of its barcodes that one task adds up.
PAIRS = 2_000_000

CRIB_TYPES = ("err", "htA", "htB", "hom", "mul")


def linked_read_hits(pairs: DataFrame, spec: HashSpec = LINKED_READ_SPEC) -> DataFrame:
    """``(barcode, read, hash)`` of both whole mates of ``pairs(barcode, read, seq1, seq2)``."""
    inserts = F.array(F.expr(f"substring(seq1, {MATE1_START})"), F.col("seq2"))
    mates = pairs.select("barcode", "read", F.explode(inserts).alias("seq"))
    return sketch(mates, ["barcode", "read"], "seq", spec).select("barcode", "read", "hash")


def build_incidence(hits: DataFrame) -> DataFrame:
    """One row per barcode and hash; of several reads the least is kept."""
    return hits.groupBy("barcode", "hash").agg(F.min("read").alias("read"))


def without_last_barcode(inc: DataFrame) -> DataFrame:
    """For parity with readers that stop before the block of the largest barcode."""
    top = inc.agg(F.max("barcode").alias("top"))
    return inc.join(F.broadcast(top)).where(F.col("barcode") < F.col("top")).drop("top")


def code_table(inc: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """``(barcode, n_read, n_hash)``. ``reads(barcode, read)`` adds reads and barcodes without hits."""
    if reads is None:
        return inc.groupBy("barcode").agg(
            F.count_distinct("read").alias("n_read"), F.count("hash").alias("n_hash")
        )
    stacked = reads.select("barcode", F.lit(0).alias("h"), F.lit(1).alias("r")).unionByName(
        inc.select("barcode", F.lit(1).alias("h"), F.lit(0).alias("r"))
    )
    return stacked.groupBy("barcode").agg(F.sum("r").alias("n_read"), F.sum("h").alias("n_hash"))


def incidence_totals(codes: DataFrame) -> DataFrame:
    """Reads, barcodes and hashes with their ratios, from a code table."""
    return codes.agg(
        F.sum("n_read").alias("n_reads"),
        F.count("*").alias("n_barcodes"),
        F.sum("n_hash").alias("n_hashes"),
    ).select(
        "*",
        F.try_divide(F.col("n_reads").cast("double"), F.col("n_barcodes")).alias("reads_per_barcode"),
        F.try_divide(F.col("n_hashes").cast("double"), F.col("n_reads")).alias("hashes_per_read"),
        F.try_divide(F.col("n_hashes").cast("double"), F.col("n_barcodes")).alias("hashes_per_barcode"),
    )


def hash_depths(inc: DataFrame) -> DataFrame:
    return inc.groupBy("hash").agg(F.count("*").alias("depth"))


def inverse_totals(inc: DataFrame) -> DataFrame:
    """Size of the inverse table: stored hashes, barcodes and distinct hashes.

    Two aggregations to distinct keys instead of a double distinct, which would triple the rows.
    """
    by_hash = hash_depths(inc).agg(F.sum("depth").alias("n_hashes"), F.count("*").alias("n_bins"))
    codes = inc.select("barcode").distinct().agg(F.count("*").alias("n_barcodes"))
    return by_hash.join(F.broadcast(codes)).select("n_hashes", "n_barcodes", "n_bins")


def hash_ids(inc: DataFrame) -> DataFrame:
    """Rank of each hash by first barcode, then by value: its number in order of first encounter.

    Ranks are pieced together from value ranges, not from one global sort.
    """
    first = inc.groupBy("hash").agg(F.min("barcode").alias("first_barcode"))
    return global_rank(first, "first_barcode", "hash", "hash_id").select("hash", "hash_id")


def in_range(depths: DataFrame, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """Hashes whose depth lies in any of the half-open ``(low, high)`` ranges."""
    if not ranges:
        raise ValueError("a depth range is required")
    wanted = F.lit(False)
    for low, high in ranges:
        wanted = wanted | ((F.col("depth") >= low) & (F.col("depth") < high))
    return depths.where(wanted)


def middle_range(depths: DataFrame, factor: int = 2) -> tuple[int, int]:
    """The depths from a ``factor``-th of the median to ``factor`` times it, as a half-open range."""
    median = hist.summary(hist.histogram(depths, "depth")).first()["median"] or 0
    return -(-median // factor), median * factor + 1


def depth_histogram(inc: DataFrame) -> DataFrame:
    return hist.histogram(hash_depths(inc), "depth")


def code_size_histogram(codes: DataFrame, column: str = "n_hash") -> DataFrame:
    return hist.histogram(codes, column)


# ---------------------------------------------------------------------------------- neighbours


def neighbours(inc: DataFrame, ranged: DataFrame, targets: DataFrame) -> DataFrame:
    """``(x, hash, share)``: how many barcodes each target ``x`` shares with each ranged hash.

    For a list of hashes asked about: ``targets(x)`` drives the join, so the work is the rows of the
    barcodes that carry a target, combined map-side per ``(x, hash)``. For share counts alone use
    :func:`share_histogram`.
    """
    carriers = inc.join(targets.select(F.col("x").alias("hash")).distinct(), "hash", "left_semi")
    carriers = carriers.select(F.col("hash").alias("x"), "barcode")
    shared = (
        carriers.join(inc.select("barcode", "hash"), "barcode")
        .where(F.col("x") != F.col("hash"))
        .groupBy("x", "hash")
        .agg(F.count("*").alias("share"))
    )
    return shared.join(ranged.select("hash"), "hash", "left_semi").select("x", "hash", "share")


def share_counts(near: DataFrame) -> DataFrame:
    """``(x, share, n)`` from a neighbour table: number of neighbours of ``x`` per share count."""
    return near.groupBy("x", "share").agg(F.count("*").alias("n"))


def share_histogram(inc: DataFrame, ranged: DataFrame, targets: DataFrame) -> DataFrame:
    """``(x, share, n)``: number of ranged hashes sharing ``share`` barcodes with each target ``x``.

    Both sides are cut to their hashes before they meet within barcodes, so that the pairs formed are those
    asked for; a depth range bounds them by the range times the rows of the targets. A barcode with very many ranged
    hashes is cut into parts, which its targets meet one by one. Pairs are counted first, so that a task adds up ``PAIRS`` of them.
    """
    return share_counts(_near(inc, ranged, targets))


def _near(inc: DataFrame, ranged: DataFrame, targets: DataFrame) -> DataFrame:
    """``(x, hash, share)`` of each target and the ranged hashes it meets."""
    kept = inc.join(ranged.select("hash").distinct(), "hash", "left_semi").select("barcode", "hash")
    carriers = inc.join(targets.select(F.col("x").alias("hash")).distinct(), "hash", "left_semi")
    carriers = carriers.select(F.col("hash").alias("x"), "barcode")
    sizes = kept.groupBy("barcode").agg(F.count("*").alias("_n")).join(
        carriers.groupBy("barcode").agg(F.count("*").alias("_m")), "barcode"
    )
    sizes = cut_lineage(sizes)
    hot = skew.parts_of(sizes, "barcode", "_n")
    pairs = sizes.agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0
    parts = max(int(inc.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
    met = skew.copied(carriers, hot, "barcode").join(skew.cut(kept, hot, "barcode", "hash"), ["barcode", "_part"])
    # few pairs of a task are equal, so they are not counted before they are dealt; the range bounds the rows of a pair
    dealt = met.where(F.col("x") != F.col("hash")).select("x", "hash").repartition(parts, "x", "hash")
    return dealt.groupBy("x", "hash").agg(F.count("*").alias("share"))


def explore(near: DataFrame, samples: int = 7) -> DataFrame:
    """Per share count the number of neighbours and the last ``samples`` of them by hash."""
    order = Window.partitionBy("x", "share").orderBy(F.desc("hash"))
    last = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= samples)
    shown = last.groupBy("x", "share").agg(
        F.sort_array(F.collect_list("hash")).alias("sample_hashes")
    )
    return share_counts(near).join(shown, ["x", "share"])


def double_shared(near: DataFrame, x1: int, x2: int, inc: DataFrame, above: int = 2) -> DataFrame:
    """Hashes that share more than ``above`` barcodes with both targets, with their first barcode."""
    often = near.where(F.col("share") > above)
    one = often.where(F.col("x") == x1).select("hash", F.col("share").alias("n1"))
    two = often.where(F.col("x") == x2).select("hash", F.col("share").alias("n2"))
    both = one.join(two, "hash")
    first = inc.join(both, "hash", "left_semi").groupBy("hash").agg(
        F.min("barcode").alias("first_barcode")
    )
    return both.join(first, "hash").select("hash", "first_barcode", "n1", "n2")


def hash_info(depths: DataFrame, near: DataFrame, targets: DataFrame) -> DataFrame:
    """Depth of each target and, where there is one, its best neighbour (ties: highest hash)."""
    best = near.groupBy("x").agg(
        F.max("share").alias("max_share"),
        F.max_by("hash", F.struct("share", "hash")).alias("best_hash"),
    )
    known = depths.select(F.col("hash").alias("x"), "depth")
    return targets.select("x").distinct().join(known, "x").join(best, "x", "left")


def scan_targets(
    depths: DataFrame, count_min: int, count_max: int, per_depth: int = 10, step: int = 100
) -> DataFrame:
    """Sampled targets ``(x, depth)``: every ``step``-th hash number, ``per_depth`` for each depth."""
    order = Window.partitionBy("depth").orderBy("hash")
    picked = depths.where(
        (F.col("depth") >= count_min)
        & (F.col("depth") < count_max)
        & (F.col("hash") >= count_max)
        & ((F.col("hash") - count_max) % step == 0)
    )
    return (
        picked.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= per_depth)
        .select(F.col("hash").alias("x"), "depth")
    )


def without_top_match(shares: DataFrame) -> DataFrame:
    """Share histograms with one neighbour taken from each top bin; an emptied bin goes."""
    top = Window.partitionBy("x")
    return (
        shares.withColumn("_top", F.max("share").over(top))
        .withColumn("n", F.col("n") - (F.col("share") == F.col("_top")).cast("bigint"))
        .where(F.col("n") > 0)
        .drop("_top")
    )


def share_scan(inc: DataFrame, ranged: DataFrame, targets: DataFrame) -> DataFrame:
    """``(depth, x, share, n)`` for sampled targets, without the top match of each."""
    shares = without_top_match(share_histogram(inc, ranged, targets))
    return shares.join(targets.select("x", "depth"), "x").select("depth", "x", "share", "n")


def error_scores(shares: DataFrame, depths: DataFrame) -> DataFrame:
    """``(x, depth, max_share, score)``; ``score`` is NULL for targets too thin to judge.

    With the top match removed and at least one share above ``LOW_SHARE`` left, the score is the sum of
    ``(share - LOW_SHARE)**2`` over such neighbours, divided by all neighbours and by the depth less
    ``LOW_SHARE``.
    """
    excess = F.col("share") - LOW_SHARE
    folded = without_top_match(shares).groupBy("x").agg(
        F.max("share").alias("max_share"),
        F.sum("n").alias("n"),
        F.sum(F.when(excess > 0, F.col("n") * excess * excess).otherwise(0)).alias("weight"),
    )
    judged = (F.col("depth") >= MIN_SCORED_DEPTH) & (F.col("max_share") > LOW_SHARE)
    score = F.col("weight") / (F.col("n") * (F.col("depth") - LOW_SHARE)).cast("double")
    return (
        depths.select(F.col("hash").alias("x"), "depth")
        .join(folded, "x", "left")
        .select("x", "depth", "max_share", F.when(judged, score).alias("score"))
    )


def flag_errors(scores: DataFrame, crib: DataFrame) -> DataFrame:
    """Attach the truth class and mark scores on the wrong side of the cut for their class."""
    typed = scores.join(crib.select(F.col("hash").alias("x"), "type"), "x")
    wrong = F.when(F.col("type") == "err", F.col("score") > SCORE_CUT).otherwise(
        F.col("score") < SCORE_CUT
    )
    return typed.withColumn("flagged", F.coalesce(wrong, F.lit(False)))


def score_summary(typed_scores: DataFrame, ranged: DataFrame) -> DataFrame:
    """Per truth class: targets too thin, scored targets, the least, mean and largest score, and how many targets lie
    outside the depth range, so that they are nobody's neighbours."""
    inside = ranged.select(F.col("hash").alias("x"), F.lit(True).alias("inside"))
    return typed_scores.join(inside, "x", "left").groupBy("type").agg(
        F.count_if(F.col("score").isNull()).alias("low"),
        F.count("score").alias("n"),
        F.coalesce(F.min("score"), F.lit(1.0)).alias("min_score"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"),
        F.count_if(F.col("inside").isNull()).alias("outside"),
    )


def hash_label(has_crib: bool = True) -> Column:
    """``hash:type_chr.pos-depth`` from columns ``hash, type, chr, pos, depth``."""
    depth = F.concat(F.lit("-"), F.col("depth"))
    if not has_crib:
        return F.concat(F.col("hash").cast("string"), depth)
    place = F.when(
        F.col("type").isin("htA", "htB", "hom"), F.format_string("_%d.%d", "chr", "pos")
    ).otherwise("")
    return F.concat(F.col("hash").cast("string"), F.lit(":"), F.col("type"), place, depth)
