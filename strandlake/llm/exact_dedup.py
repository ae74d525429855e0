"""Exact duplicates by two passes over a Bloom filter.

Texts are compared by the SHA-256 of their normal form (A-Z in lower case, null as empty).

1. The first pass counts how many rows set each of ``2**filter_bits`` slots; a row sets two. Slots set
   more than once are kept as 64-bit words, at most ``2**(filter_bits - 6)`` of them, whatever the input.
2. The second pass looks both slots of every row up in the broadcast words. A row with a slot that no
   other row set is the only one of its text and passes straight through. The rest, which may have a
   copy, shuffle by hash and are grouped exactly, so that a full filter costs time but never a result.

Of equal texts the row with the largest id stays. Nulls: a null text equals an empty one; a null id is
smaller than any other. Rows that repeat both id and text are one document to ``duplicates`` (all have the
same answer) and leave one row in ``deduplicate``. Other columns, whatever their names, are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import all_salts, ascii_lower, salt

#: 2**25 slots: at most 524,288 words of 16 bytes are broadcast.
FILTER_BITS = 25

_ID, _SHA, _SLOT, _WORD, _MASK = "__id", "__sha", "__slot", "__word", "__mask"


def text_sha256(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def _slots(sha: str, filter_bits: int) -> tuple[Column, Column]:
    spread, size = F.xxhash64(sha), F.lit(1 << filter_bits)
    return F.pmod(spread, size), F.pmod(F.shiftright(spread, 32), size)


def repeated_slots(rows: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """First pass: ``(__word, __mask)`` of the slots that more than one row of ``rows`` sets."""
    slots = rows.select(F.explode(F.array_distinct(F.array(*_slots(_SHA, filter_bits)))).alias(_SLOT))
    often = slots.groupBy(_SLOT).agg(F.count("*").alias("n")).where("n > 1")
    bit = F.expr(f"shiftleft(1L, cast({_SLOT} & 63 AS int))")
    return often.groupBy(F.shiftright(_SLOT, 6).alias(_WORD)).agg(F.bit_or(bit).alias(_MASK))


def flag_repeats(rows: DataFrame, words: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Second pass: add ``__maybe``, false only for rows whose hash no other row has."""
    maybe = F.lit(True)
    for number, slot in enumerate(_slots(_SHA, filter_bits)):
        word, mask, name = f"{_WORD}{number}", f"{_MASK}{number}", f"{_SLOT}{number}"
        side = F.broadcast(words.select(F.col(_WORD).alias(word), F.col(_MASK).alias(mask)))
        rows = rows.withColumn(name, slot)
        rows = rows.join(side, F.shiftright(name, 6) == F.col(word), "left").drop(word)
        maybe = maybe & (F.coalesce(F.getbit(mask, (F.col(name) % 64).cast("int")), F.lit(0)) == 1)
    return rows.withColumn("__maybe", maybe).drop(*[f"{x}{i}" for x in (_SLOT, _MASK) for i in (0, 1)])


def _hashed(docs: DataFrame, id_col: str, text_col: str, filter_bits: int):
    """Hashes of all rows, written once, and the words of the first pass."""
    rows = cut_lineage(docs.select(F.col(id_col).alias(_ID), text_sha256(F.col(text_col)).alias(_SHA)))
    return rows, cut_lineage(repeated_slots(rows, filter_bits))


def _groups(repeats: DataFrame) -> DataFrame:
    return repeats.groupBy(_SHA).agg(F.max(_ID).alias("keep_id"), F.count("*").alias("group_size"))


def duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS
) -> DataFrame:
    """``(id_col, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``."""
    rows, words = _hashed(docs, id_col, text_col, filter_bits)
    flagged = flag_repeats(rows, words, filter_bits)
    alone = flagged.where("NOT __maybe").select(
        _ID, F.col(_ID).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), _SHA
    )
    repeats = flagged.where("__maybe").select(_ID, _SHA)
    # a text may have very many copies: its one group row is copied to each salt
    groups = _groups(repeats).select(_SHA, "keep_id", "group_size", all_salts().alias("__salt"))
    grouped = repeats.withColumn("__salt", salt(_ID)).join(groups, [_SHA, "__salt"])
    return alone.unionByName(grouped.drop("__salt")).select(
        F.col(_ID).alias(id_col), "keep_id", "group_size",
        F.col(_ID).eqNullSafe(F.col("keep_id")).alias("kept"), F.col(_SHA).alias("text_sha256"),
    )


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS
) -> DataFrame:
    """The rows of ``docs`` that stay. Only rows that may have a copy are shuffled with their columns."""
    rows, words = _hashed(docs, id_col, text_col, filter_bits)
    keepers = _groups(flag_repeats(rows, words, filter_bits).where("__maybe")).select(
        F.col(_SHA).alias("__keep_sha"), F.col("keep_id").alias("__keep_id")
    )
    flagged = flag_repeats(docs.withColumn(_SHA, text_sha256(F.col(text_col))), words, filter_bits)
    alone = flagged.where("NOT __maybe").drop("__maybe", _SHA)
    same = (F.col(_SHA) == F.col("__keep_sha")) & F.col(id_col).eqNullSafe(F.col("__keep_id"))
    stay = flagged.where("__maybe").join(keepers, same, "left_semi").dropDuplicates([id_col, _SHA])
    return alone.unionByName(stay.select(*alone.columns))
