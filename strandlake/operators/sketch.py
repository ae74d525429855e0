"""From sequences to sampled k-mers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_hash
from ..functions.sampling import minimizer_udf, sketch_udf
from ..spec import HashSpec, SKETCH_SPEC


def _hits(df: DataFrame, keep: Sequence[str | Column], array: Column) -> DataFrame:
    return df.select(*keep, F.inline(array))


def sketch(
    df: DataFrame,
    keep: Sequence[str | Column],
    seq: str | Column = "seq",
    spec: HashSpec = SKETCH_SPEC,
) -> DataFrame:
    """One row per sampled k-mer: ``keep`` columns, then ``ord, pos, hash, is_fwd``.

    Sampling happens inside the Arrow function, so only one k-mer in ``w`` ever reaches the JVM.
    """
    column = F.col(seq) if isinstance(seq, str) else seq
    return _hits(df, keep, sketch_udf(spec)(column))


def minimizers(
    df: DataFrame,
    keep: Sequence[str | Column],
    seq: str | Column = "seq",
    spec: HashSpec = SKETCH_SPEC,
) -> DataFrame:
    """Jumping minimizers, with the columns of :func:`sketch`."""
    column = F.col(seq) if isinstance(seq, str) else seq
    return _hits(df, keep, minimizer_udf(spec)(column))


def split_long_sequences(
    df: DataFrame, seq: str, spec: HashSpec = SKETCH_SPEC, max_bases: int = 1 << 22
) -> DataFrame:
    """Cut sequences into pieces of ``max_bases`` k-mer starts that overlap by ``k - 1`` bases.

    Adds ``piece_start``; every k-mer lies in exactly one piece, so the pieces of one giant record
    can be spread over the cluster and sketched apart.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.length(seq) - spec.k, F.lit(0)), F.lit(max_bases))
    pieces = df.withColumn("piece_start", F.explode(starts))
    return pieces.withColumn(
        seq, F.substring(F.col(seq), F.col("piece_start") + 1, F.lit(max_bases + spec.k - 1))
    )


def sketch_pieces(
    df: DataFrame,
    keep: Sequence[str],
    seq: str = "seq",
    spec: HashSpec = SKETCH_SPEC,
    max_bases: int = 1 << 22,
) -> DataFrame:
    """:func:`sketch` for data with giant records: pieces are shuffled before hashing.

    Returns ``keep, pos, hash, is_fwd`` with positions in the whole sequence.
    """
    cut = split_long_sequences(df.select(*keep, seq), seq, spec, max_bases)
    spread = cut.repartition(*keep, "piece_start")
    hits = sketch(spread, [*keep, "piece_start"], seq, spec)
    return hits.select(*keep, (F.col("piece_start") + F.col("pos")).alias("pos"), "hash", "is_fwd")


def sketch_native(
    df: DataFrame,
    keep: Sequence[str | Column],
    seq: str = "seq",
    spec: HashSpec = SKETCH_SPEC,
) -> DataFrame:
    """The same hits (without ``ord``) from built-in expressions only; a cross-check, not the fast path."""
    long_enough = df.where(F.length(seq) >= spec.k)
    kmers = long_enough.select(
        *keep,
        F.col(seq).alias("_seq"),
        F.explode(F.sequence(F.lit(0), F.length(seq) - spec.k)).alias("pos"),
    )
    names = [c for c in kmers.columns if c not in ("_seq", "pos")]
    hashed = kmers.select(
        *names,
        "pos",
        canonical_hash(F.substring("_seq", F.col("pos") + 1, F.lit(spec.k)), spec).alias("_h"),
    )
    return hashed.select(*names, "pos", "_h.hash", "_h.is_fwd").where(F.col("hash") % spec.w == 0)
