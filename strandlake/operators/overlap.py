"""Long-read overlaps: reads as lists of sketch hits, pairwise overlaps, quality flags, containment.

``hits`` tables hold ``(read_id, ord, pos, hash, is_fwd, copy)``; only hashes of the sketch set appear.
Overlaps run over single-copy hashes, whose depth the copy thresholds bound; that bound is what keeps
the pair join linear in the hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..spec import HashSpec, SKETCH_SPEC
from . import skew
from .sketch import sketch

# Shared hits that make an overlap, hits below which a read without overlaps is
# called thin, and the bad overlaps that condemn a read in the first pass.
MIN_SHARED = 3
THIN_READ = 10
MANY_BAD = 10

FLAGS = ("bad_repeat", "bad_order10", "bad_order1", "bad_no_match", "bad_low_hit", "bad_low_copy1")


def _if(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def read_hits(reads: DataFrame, sketch_set: DataFrame, spec: HashSpec = SKETCH_SPEC) -> DataFrame:
    """All sampled k-mers of ``reads(read_id, seq)``; ``copy`` is NULL where the set lacks the hash."""
    return with_copy(sketch(reads, ["read_id"], "seq", spec), sketch_set)


def with_copy(found: DataFrame, sketch_set: DataFrame) -> DataFrame:
    """The same of k-mers that have been sampled."""
    return found.join(sketch_set.select("hash", "copy"), "hash", "left").select(
        "read_id", "ord", "pos", "hash", "is_fwd", "copy"
    )


def known_hits(all_hits: DataFrame) -> DataFrame:
    return all_hits.where(F.col("copy").isNotNull())


def read_table(reads: DataFrame, all_hits: DataFrame) -> DataFrame:
    """``(read_id, len, n_hit, n_miss, n_copy0..3)`` of every read, also of those without hits."""
    per_read = all_hits.groupBy("read_id").agg(
        F.count("copy").alias("n_hit"),
        F.count_if(F.col("copy").isNull()).alias("n_miss"),
        *[F.count_if(F.col("copy") == c).alias(f"n_copy{c}") for c in range(4)],
    )
    sizes = reads.select("read_id", F.length("seq").alias("len"))
    return sizes.join(per_read, "read_id", "left").fillna(0)


def hit_depths(hits: DataFrame) -> DataFrame:
    """``(hash, depth)``: occurrences in the reads."""
    return hits.groupBy("hash").agg(F.count("*").alias("depth"))


def single_copy_hits(hits: DataFrame) -> DataFrame:
    """Hits that take part in overlaps: copy class 1."""
    return hits.where(F.col("copy") == 1)


def first_hits(hits: DataFrame) -> DataFrame:
    """``(read_id, hash, ord, pos, is_fwd)`` of the first occurrence of each hash in each read.

    Order, position and strand travel as one number, so that the minimum needs no sort.
    """
    strand = F.shiftleft(F.col("pos").cast("bigint"), 1).bitwiseOR(F.col("is_fwd").cast("bigint"))
    packed = F.shiftleft(F.col("ord").cast("bigint"), 32).bitwiseOR(strand)
    least = hits.groupBy("read_id", "hash").agg(F.min(packed).alias("at"))
    at = F.col("at")
    return least.select(
        "read_id", "hash",
        F.shiftright(at, 32).cast("int").alias("ord"),
        F.shiftright(at.bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int").alias("pos"),
        (at.bitwiseAND(F.lit(1)) == 1).alias("is_fwd"),
    )


def shared_hits(hits: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Pairs of hits ``x`` (first occurrence in its read) and ``y`` (any occurrence), also within one read.

    ``wanted(read_id)`` restricts ``x``. Copy classes of the reads' own set bound the occurrences of a hash; those of
    another set do not, so a hash with very many is cut into parts.
    """
    single = single_copy_hits(hits)
    x_side = single.join(wanted, "read_id", "left_semi") if wanted is not None else single
    x = first_hits(x_side).select(
        "hash", F.col("read_id").alias("x"), F.col("ord").alias("x_ord"),
        F.col("pos").alias("x_pos"), F.col("is_fwd").alias("x_fwd"),
    )
    y = single.select(
        "hash", F.col("read_id").alias("y"), F.col("ord").alias("y_ord"),
        F.col("pos").alias("y_pos"), F.col("is_fwd").alias("y_fwd"),
    )
    hot = skew.hot_keys(single, "hash")
    if hot.isEmpty():
        # sides that are cut are dealt once more
        return x.join(y, "hash")
    return skew.copied(x, hot, "hash").join(skew.cut(y, hot, "hash", "y", "y_ord"), ["hash", "_part"]).drop("_part")


def overlaps(hits: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One row per ordered pair of reads sharing ``MIN_SHARED`` or more hits, with each read's self pair.

    Columns ``x, y, n_hit, n_plus, n_minus, mean_offset, sd, offset, is_plus, is_bad``. On one strand,
    positions in ``x`` must rise (or, reversed, fall) along ``y``; a pair that breaks the order, or mixes
    strands, is bad. ``n_plus`` and ``n_minus`` count hits in order. The offset is ``x`` less ``y`` on the
    same strand and ``x`` plus ``y`` on opposite strands.
    """
    along = Window.partitionBy("x", "y").orderBy("y_ord")
    same = F.col("x_fwd") == F.col("y_fwd")
    rows = shared_hits(hits, wanted).select(
        "x", "y", "x_pos", "y_pos", same.alias("same"),
        (F.col("x_ord") - F.lag("x_ord").over(along)).alias("step"),
    )
    plus = F.col("x_pos") - F.col("y_pos")
    minus = F.col("x_pos") + F.col("y_pos")

    def total(z: Column) -> Column:
        return F.sum(z.cast("bigint"))

    def squares(z: Column) -> Column:
        return F.sum(z.cast("double") * z.cast("double"))

    pairs = rows.groupBy("x", "y").agg(
        F.count("*").alias("n_hit"),
        F.count_if("same").alias("same_hits"),
        F.count_if(_if(F.col("step") < 0)).alias("drops"),
        F.count_if(_if(F.col("step") > 0)).alias("rises"),
        total(plus).alias("p1"), squares(plus).alias("p2"),
        total(minus).alias("m1"), squares(minus).alias("m2"),
    ).where(F.col("n_hit") >= MIN_SHARED)
    n, same_hits = F.col("n_hit"), F.col("same_hits")
    all_plus, all_minus = same_hits == n, same_hits == 0

    def by_strand(if_plus, if_minus, if_mixed=F.lit(0)):
        return F.when(all_plus, if_plus).when(all_minus, if_minus).otherwise(if_mixed)

    first = by_strand(F.col("p1"), F.col("m1"))
    second = by_strand(F.col("p2"), F.col("m2"), F.lit(0.0))
    mean = first / n.cast("double")
    variance = F.greatest(second / n - mean * mean, F.lit(0.0))
    return pairs.select(
        "x", "y", "n_hit",
        by_strand(n - F.col("drops"), F.lit(0), same_hits).alias("n_plus"),
        by_strand(F.lit(0), n - F.col("rises"), n - same_hits).alias("n_minus"),
        mean.alias("mean_offset"),
        F.sqrt(variance).alias("sd"),
        mean.cast("int").alias("offset"),
        all_plus.alias("is_plus"),
        by_strand(F.col("drops") > 0, F.col("rises") > 0, F.lit(True)).alias("is_bad"),
    )


def hit_pairs(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every pair of equal single-copy hits of the read pairs ``pairs(x, y)``, with relative strand."""
    single = hits.where(F.col("copy") == 1)
    depth = hit_depths(hits)

    def side(s: str) -> DataFrame:
        return single.select(
            F.col("read_id").alias(s), "hash", F.col("pos").alias(f"{s}_pos"),
            F.col("is_fwd").alias(f"{s}_fwd"),
        )

    matched = pairs.join(side("x"), "x").join(side("y"), ["y", "hash"])
    return matched.join(depth, "hash").select(
        "x", "y", "hash", "depth",
        F.when(F.col("x_fwd") == F.col("y_fwd"), "+").otherwise("-").alias("strand"),
        "x_pos", F.when(F.col("x_fwd"), "F").otherwise("R").alias("x_strand"),
        "y_pos", F.when(F.col("y_fwd"), "F").otherwise("R").alias("y_strand"),
    )


def repeat_counts(hits: DataFrame) -> DataFrame:
    """``(read_id, n_repeat)``: later occurrences of single-copy hashes within a read."""
    single = hits.where(F.col("copy") == 1)
    per_hash = single.groupBy("read_id", "hash").agg((F.count("*") - 1).alias("again"))
    return per_hash.groupBy("read_id").agg(F.sum("again").alias("n_repeat"))


def read_report(table: DataFrame, hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per read: its counts, its repeated hashes, and its good and bad overlaps."""
    tally = pairs.groupBy(F.col("x").alias("read_id")).agg(
        F.count_if(~F.col("is_bad")).alias("n_good"), F.count_if("is_bad").alias("n_bad")
    )
    return (
        table.join(repeat_counts(hits), "read_id", "left")
        .join(tally, "read_id", "left")
        .fillna(0, ["n_repeat", "n_good", "n_bad"])
    )


def bad_overlap_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("x").agg(F.count_if("is_bad").alias("n_bad"))


# ----------------------------------------------------------------------------- quality flags


def _judged(state: DataFrame, least_bad: int, flag: str) -> DataFrame:
    """What each read earns in a pass, from its tallies ``n_seen`` and ``n_bad``."""
    lonely = F.col("n_seen") == 0
    hit = F.col("n_bad") >= least_bad
    if flag != "bad_order10":
        hit = hit & ~F.col("bad_order10")
    judged = state.withColumns({
        "new_no_match": lonely,
        "new_low_hit": lonely & (F.col("n_hit") < THIN_READ),
        "new_low_copy1": lonely & (F.col("n_hit") >= THIN_READ) & (F.col("n_copy1") < THIN_READ),
        "new_flag": hit,
    })
    now = F.col("bad_repeat") | F.col("new_no_match") | F.col("new_flag")
    return judged.withColumn("was_now", F.col("bad_now")).withColumn("bad_now", now)


def _tally(links: DataFrame, sign: Column | int = 1) -> DataFrame:
    sign = F.lit(sign) if isinstance(sign, int) else sign
    return links.groupBy(F.col("x").alias("read_id")).agg(
        F.sum(sign).alias("seen"), F.sum(F.when(F.col("is_bad"), sign).otherwise(0)).alias("bad_seen")
    )


def _pass(
    state: DataFrame, links: DataFrame, least_bad: int, flag: str, sequential: bool
) -> tuple[DataFrame, int]:
    """One flagging pass over all reads.

    ``state`` carries the flags before the pass; ``links(x, y, is_bad)`` the overlaps. A read looks at
    overlaps with reads that are not bad. In a sequential pass it also sees the flags that smaller read
    ids earn in the same pass: those are found by judging until the flags stand still. Flags
    of a read depend on smaller ids only, so the fixed point is unique and is what a scan in id order
    gives. Tallies are kept: after the first round only overlaps with reads whose flag has just changed are
    joined, and change them.
    """
    any_bad = F.lit(False)
    for name in FLAGS:
        any_bad = any_bad | F.col(name)
    # The repeat flag is set when a read is first looked at, so the first pass does not know it before.
    before = F.lit(False) if flag == "bad_order10" else any_bad
    view = state.select(F.col("read_id").alias("y"), before.alias("bad_before"), "bad_repeat")
    hidden = F.col("bad_before") | (F.col("bad_repeat") & (F.col("y") == F.col("x")))
    open_links = links.join(view, "y").where(~hidden)
    if sequential:
        first = open_links.where(~(F.col("bad_repeat") & (F.col("y") < F.col("x"))))
        later = cut_lineage(open_links.where(F.col("y") < F.col("x")).select("x", "y", "is_bad"))
    else:
        first = open_links
    current = (
        state.withColumn("bad_now", F.col("bad_repeat"))
        .join(_tally(first), "read_id", "left").fillna(0, ["seen", "bad_seen"])
        .withColumnsRenamed({"seen": "n_seen", "bad_seen": "n_bad"})
    )
    working = list(current.columns)
    judged = cut_lineage(_judged(current, least_bad, flag))
    while sequential:
        flipped = judged.where(F.col("bad_now") != F.col("was_now")).select(
            F.col("read_id").alias("y"), F.when(F.col("bad_now"), -1).otherwise(1).alias("sign")
        )
        if flipped.isEmpty():
            break
        change = _tally(later.join(flipped, "y"), F.col("sign"))
        current = judged.select(*working).join(change, "read_id", "left").fillna(0, ["seen", "bad_seen"])
        current = current.withColumns(
            {"n_seen": F.col("n_seen") + F.col("seen"), "n_bad": F.col("n_bad") + F.col("bad_seen")}
        )
        judged = cut_lineage(_judged(current.select(*working), least_bad, flag))
    n_flagged = judged.where("new_flag").count()
    done = judged.select(
        *[c for c in state.columns if c not in FLAGS],
        "bad_repeat",
        *[
            (F.col(name) | F.col("new_flag") if name == flag else F.col(name)).alias(name)
            for name in ("bad_order10", "bad_order1")
        ],
        (F.col("bad_no_match") | F.col("new_no_match")).alias("bad_no_match"),
        (F.col("bad_low_hit") | F.col("new_low_hit")).alias("bad_low_hit"),
        (F.col("bad_low_copy1") | F.col("new_low_copy1")).alias("bad_low_copy1"),
    )
    return done, n_flagged


def mark_bad_reads(
    table: DataFrame, hits: DataFrame, pairs: DataFrame, mode: str = "sequential"
) -> tuple[DataFrame, dict[str, int]]:
    """Flag reads in three passes of rising strictness; returns the flagged table and the pass counts.

    Pass 1 marks reads with ``MANY_BAD`` or more bad overlaps, pass 2 those with more than one, pass 3
    those with any. Along the way reads get marked that repeat a single-copy hash or overlap nothing.
    ``mode="sequential"`` gives exactly what visiting reads in id order gives; ``mode="frozen"`` judges
    every read of a pass by the flags before it, in one round per pass.
    """
    if mode not in ("sequential", "frozen"):
        raise ValueError(f"unknown mode {mode!r}")
    sequential = mode == "sequential"
    links = cut_lineage(pairs.select("x", "y", "is_bad"))
    state = (
        table.join(repeat_counts(hits), "read_id", "left")
        .withColumn("bad_repeat", F.coalesce("n_repeat", F.lit(0)) > 0)
        .drop("n_repeat")
        .withColumns({name: F.lit(False) for name in FLAGS[1:]})
    )
    counts = {}
    for label, flag, least in (
        ("many", "bad_order10", MANY_BAD), ("multiple", "bad_order1", 2), ("single", "bad_order1", 1)
    ):
        state, counts[label] = _pass(state, links, least, flag, sequential)
    return with_bad(state), counts


def with_bad(state: DataFrame) -> DataFrame:
    any_bad = F.lit(False)
    for name in FLAGS:
        any_bad = any_bad | F.col(name)
    return state.withColumn("bad", any_bad)


# ------------------------------------------------------------------------------- containment


def mark_contained(flagged: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(read_id, len, contained_in, n_hit)`` of good reads: the good read covering each with most hits.

    Ties go to the lowest id. On the same strand the cover must start no later and end no earlier; on
    the opposite strand the mirrored test holds.
    """
    good = flagged.where(~F.col("bad")).select("read_id", "len")
    x_len, y_len = F.col("x_len"), F.col("y_len")
    offset = F.col("offset")
    covers = F.when(
        F.col("is_plus"), (offset <= 0) & (offset + y_len >= x_len)
    ).otherwise((offset >= x_len) & (offset - y_len <= 0))
    candidates = (
        pairs.where(F.col("x") != F.col("y"))
        .join(good.select(F.col("read_id").alias("x"), F.col("len").alias("x_len")), "x")
        .join(good.select(F.col("read_id").alias("y"), F.col("len").alias("y_len")), "y")
        .where((y_len >= x_len) & covers)
    )
    best = candidates.groupBy(F.col("x").alias("read_id")).agg(
        F.max_by("y", F.struct(F.col("n_hit"), -F.col("y"))).alias("contained_in"),
        F.max("n_hit").alias("n_hit"),
    )
    return good.join(best, "read_id", "left")


def containment_summary(contained: DataFrame) -> DataFrame:
    free = F.col("contained_in").isNull()
    return contained.agg(
        F.count("contained_in").alias("n_contained"),
        F.count_if(free).alias("n_free"),
        F.coalesce(F.avg(F.when(free, F.col("len"))), F.lit(0.0)).alias("free_avg_len"),
    )


# -------------------------------------------------------------------------------- statistics


def readset_stats(table: DataFrame) -> DataFrame:
    """One row of totals over a read table (with flags, where it has them)."""
    n = F.count("*")
    length = F.col("len").cast("bigint")
    none, one = F.col("n_copy1") == 0, F.col("n_copy1") == 1
    more = F.col("n_copy1") > 1

    def ratio(a: Column, b: Column) -> Column:
        return F.try_divide(a.cast("double"), b)

    hits, miss, total = F.sum("n_hit"), F.sum("n_miss"), F.sum(length)
    columns = [
        n.alias("n_reads"), total.alias("total_len"), ratio(total, n).alias("avg_len"),
        hits.alias("total_hit"), ratio(total, hits).alias("bp_per_hit"),
        ratio(hits, hits + miss).alias("frac_hit"), ratio(hits, n).alias("hits_per_read"),
        *[ratio(F.sum(f"n_copy{c}"), hits).alias(f"frac_copy{c}") for c in range(4)],
        F.count_if(none).alias("n_unique0"), F.count_if(one).alias("n_unique1"),
        F.count_if(more).alias("n_unique_multi"),
        F.avg(F.when(none, length)).alias("avg_len_unique0"),
        F.avg(F.when(one, length)).alias("avg_len_unique1"),
        F.avg(F.when(more, length)).alias("avg_len_unique_multi"),
        F.avg(F.when(more, F.col("n_copy1"))).alias("avg_copy1_unique_multi"),
    ]
    if "bad" in table.columns:
        columns += [F.count_if(F.col(f)).alias(f"n_{f}") for f in ("bad", *FLAGS)]
    return table.agg(*columns)


def class_stats(sketch_set: DataFrame, hits: DataFrame) -> DataFrame:
    """Per copy class: hashes, the fractions hit and hit more than once, and their mean depth."""
    depth = F.coalesce("depth", F.lit(0))
    joined = sketch_set.select("hash", "copy").join(hit_depths(hits), "hash", "left")
    several = depth > 1
    return joined.groupBy("copy").agg(
        F.count("*").alias("n_hash"),
        (F.count_if(depth > 0) / F.count("*")).alias("frac_hit"),
        (F.count_if(several) / F.count("*")).alias("frac_hit2"),
        F.avg(F.when(several, F.col("depth"))).alias("avg_depth2"),
    )


# --------------------------------------------------------------------------------- gaps

# Fixed value: stored gaps are 16 bits wide and wrap around.
GAP_RANGE = 1 << 16


def with_gaps(hits: DataFrame, wrap: bool = False) -> DataFrame:
    """Add ``dx``: the distance of each hit from the one before it in its read (the first: from 0)."""
    along = Window.partitionBy("read_id").orderBy("ord")
    gap = F.col("pos") - F.coalesce(F.lag("pos").over(along), F.lit(0))
    return hits.withColumn("dx", gap % GAP_RANGE if wrap else gap)


def positions_from_gaps(hits: DataFrame) -> DataFrame:
    """Restore ``pos`` from ``dx``."""
    so_far = Window.partitionBy("read_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("pos", F.sum("dx").over(so_far).cast("int"))


# --------------------------------------------------------------------------------- assembly


def pooled_hits(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hits of all reads overlapping a chosen read, pooled by hash.

    ``pairs`` are the overlaps of that read. Per hash: occurrences, occurrences with a hit before them,
    and the mean position on the chosen read.
    """
    place = F.col("offset") + F.when(F.col("is_plus"), F.col("pos")).otherwise(-F.col("pos"))
    placed = hits.join(
        pairs.select(F.col("y").alias("read_id"), "offset", "is_plus"), "read_id"
    )
    before = Window.partitionBy("read_id").orderBy("ord")
    return (
        placed.withColumn("_first", F.row_number().over(before) == 1)
        .groupBy("hash", "copy")
        .agg(
            F.count("*").alias("count"),
            F.count_if(~F.col("_first")).alias("up_count"),
            F.try_divide(F.sum(place.cast("bigint")).cast("double"), F.count("*")).cast("int").alias("pos"),
        )
    )


def successors(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(hash, next_hash, n)``: how often one hash directly follows another in the pooled reads."""
    order = Window.partitionBy("read_id").orderBy("ord")
    pooled = hits.join(pairs.select(F.col("y").alias("read_id")), "read_id", "left_semi")
    linked = pooled.withColumn("next_hash", F.lead("hash").over(order))
    return linked.where(F.col("next_hash").isNotNull()).groupBy("hash", "next_hash").agg(
        F.count("*").alias("n")
    )


def assembly_summary(pooled: DataFrame) -> DataFrame:
    """Number of pooled hashes and their mean count."""
    return pooled.agg(F.count("*").alias("n_hash"), F.avg("count").alias("mean_count"))


def support_table(pooled: DataFrame, depths: DataFrame, top: int | None = None) -> DataFrame:
    """``(count, depth, decile, n)`` of pooled single-copy hashes.

    ``top`` lets both counts stop there, for parity with printed tables of that size.
    """
    single = pooled.where(F.col("copy") == 1).join(depths, "hash")
    decile = F.floor((10 * F.col("count") - 1) / F.col("depth"))

    def shown(name: str) -> Column:
        return (F.col(name) if top is None else F.least(name, F.lit(top))).cast("bigint").alias(name)

    return single.groupBy(shown("count"), shown("depth"), decile.cast("int").alias("decile")).agg(
        F.count("*").alias("n")
    )
