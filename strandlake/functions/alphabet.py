"""Sequence alphabets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nucleotide, ambiguity and amino-acid symbols.
BASES = "ACGT"
BASES_N = "ACGTN"
IUPAC = "ACGTRYSWKMBDHVN"
AMBIGUOUS = "RYSWKMBDHV"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWXY*"
# Bit set of the bases that each symbol may stand for (A=1, C=2, G=4, T=8).
BASE_SETS = {
    "A": 1, "C": 2, "M": 3, "G": 4, "R": 5, "S": 6, "V": 7, "T": 8,
    "W": 9, "Y": 10, "H": 11, "K": 12, "D": 13, "B": 14, "N": 15,
}

_LATIN = "abcdefghijklmnopqrstuvwxyz"


def _only(seq: Column, symbols: str) -> Column:
    """The characters of ``symbols``, in upper case; others are dropped first, as some become such letters."""
    both = symbols + "".join(c.lower() for c in symbols if c.isalpha())
    return F.upper(F.regexp_replace(seq, f"[^{both}]", ""))


def dna_text(seq: Column) -> Column:
    """Upper-case ACGTN; every other character is dropped."""
    return _only(seq, BASES_N)


def dna_text_ambiguous(seq: Column) -> Column:
    """Upper-case nucleotides, ambiguity codes and gaps; the rest is dropped."""
    return _only(seq, f"-{IUPAC}")


def dna_ambiguous_to_n(seq: Column) -> Column:
    """Like :func:`dna_text_ambiguous`, with each ambiguity code turned into N."""
    return F.translate(dna_text_ambiguous(seq), AMBIGUOUS, "N" * len(AMBIGUOUS))


def dna_index(seq: Column) -> Column:
    """Digits 0..3 for ACGT; N counts as A."""
    return F.translate(dna_text(seq), BASES_N, "01230")


def protein_text(seq: Column) -> Column:
    return _only(seq, AMINO_ACIDS)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), BASES_N, "TGCAN")


def base_sets(seq: Column) -> Column:
    """Array of base bit sets, one per symbol."""
    table = F.create_map(*[F.lit(x) for pair in BASE_SETS.items() for x in pair])
    return F.transform(F.split(dna_text_ambiguous(seq), ""), lambda c: F.try_element_at(table, c))


def letters_as_dna(text: Column) -> Column:
    """Derive a nucleotide string from prose: each ASCII letter maps to a base by its rank mod 4."""
    bases = "".join(BASES[i % 4] for i in range(len(_LATIN)))
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), _LATIN, bases)
