"""The k-mer hash as native column expressions (no Python on the data path).

ANSI arithmetic refuses to wrap, so the 64-bit product is assembled from 32-bit limbs, none of
which can exceed 2**63.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import HashSpec

_LOW = (1 << 32) - 1


def encode_kmer(kmer: Column) -> Column:
    """Two bits per base, first base most significant; N counts as A."""
    return F.conv(F.translate(kmer, "ACGTN", "01230"), 4, 10).cast("bigint")


def encode_kmer_rc(kmer: Column) -> Column:
    """The code of the reverse complement."""
    return F.conv(F.translate(F.reverse(kmer), "ACGTN", "32103"), 4, 10).cast("bigint")


def hash_code(code: Column, spec: HashSpec) -> Column:
    """``(code * factor mod 2**64) >> (64 - 2k)``."""
    high, low = spec.factor >> 32, spec.factor & _LOW
    mask = F.lit(_LOW).cast("bigint")
    x_low = code.bitwiseAND(mask)
    x_high = F.shiftrightunsigned(code, 32)
    bottom = x_low * F.lit(low)
    cross = (x_low * F.lit(high)).bitwiseAND(mask) + (x_high * F.lit(low)).bitwiseAND(mask)
    top = (F.shiftrightunsigned(bottom, 32) + cross).bitwiseAND(mask)
    word = F.shiftleft(top, 32).bitwiseOR(bottom.bitwiseAND(mask))
    return F.shiftrightunsigned(word, spec.shift)


def canonical_hash(kmer: Column, spec: HashSpec) -> Column:
    """Struct ``(hash, is_fwd)``: the smaller strand hash; a tie counts as reverse."""
    forward = hash_code(encode_kmer(kmer), spec)
    reverse = hash_code(encode_kmer_rc(kmer), spec)
    return F.struct(
        F.least(forward, reverse).alias("hash"), (forward < reverse).alias("is_fwd")
    )
