"""Two-bit bases and one-bit qualities in 32-bit words.

Single words are column expressions; whole records go through Arrow, a batch at a time.

A packed pair is 30 little-endian words: 10 of bases and 5 of qualities for each mate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .alphabet import BASES

# Layout of a packed pair, and the quality characters that set a bit.
BASES_PER_WORD = 16
QUALS_PER_WORD = 32
BASE_WORDS = 10
QUAL_WORDS = 5
RECORD_BYTES = 120
GOOD_QUALITY = "[8-~]"
OTHER_QUALITY = "[^8-~]"


def _words(digits: Column, base: int, per_word: int, n_words: int, right_justify: bool) -> Column:
    room = n_words * per_word
    message = F.concat(F.lit(f"more than {room} characters for a record: "), F.length(digits).cast("string"))
    text = F.when(F.length(digits) > room, F.raise_error(message)).otherwise(digits)
    if not right_justify:
        text = F.rpad(text, n_words * per_word, "0")
    parts = F.regexp_extract_all(text, F.lit(f".{{1,{per_word}}}"), F.lit(0))
    words = F.transform(parts, lambda part: F.conv(part, base, 10).cast("bigint"))
    if right_justify:
        words = F.slice(F.concat(words, F.array_repeat(F.lit(0).cast("bigint"), n_words)), 1, n_words)
    return words


def pack_bases(seq: Column, n_words: int, right_justify: bool = False) -> Column:
    """Words of 16 bases, first base in the top bits; anything but ACGT counts as A.

    ``right_justify`` puts the bases of a last partial word in its low bits.
    """
    digits = F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "A"), "ACGT", "0123")
    return _words(digits, 4, BASES_PER_WORD, n_words, right_justify)


def pack_qualities(qual: Column, n_words: int, right_justify: bool = False) -> Column:
    """Words of 32 bits, set for good qualities."""
    bits = F.regexp_replace(F.regexp_replace(qual, OTHER_QUALITY, "0"), GOOD_QUALITY, "1")
    return _words(bits, 2, QUALS_PER_WORD, n_words, right_justify)


def word_to_bases(word: Column) -> Column:
    return F.translate(F.lpad(F.conv(word, 10, 4), BASES_PER_WORD, "0"), "0123", "ACGT")


def word_to_bits(word: Column) -> Column:
    return F.lpad(F.conv(word, 10, 2), QUALS_PER_WORD, "0")


def unpack_bases(words: Column) -> Column:
    return F.array_join(F.transform(words, word_to_bases), "")


def unpack_qualities(words: Column) -> Column:
    return F.array_join(F.transform(words, word_to_bits), "")


def _slots(texts: pa.Array, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each text in a row of ``n_slots`` (0 beyond its end), and the lengths."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offset_buffer, data = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    lengths = np.diff(offsets)
    if len(lengths) and lengths.max() > n_slots:
        raise ValueError(f"a record has room for {n_slots} characters of a read, not for {lengths.max()}")
    out = np.zeros((len(texts), n_slots), np.uint8)
    inside = np.arange(n_slots) < lengths[:, None]
    at = offsets[:-1, None] + np.arange(n_slots)
    if data is not None:
        out[inside] = np.frombuffer(data, np.uint8)[at[inside]]
    return out, lengths


def _to_words(digits: np.ndarray, bits: int, lengths: np.ndarray, right_justify: bool) -> np.ndarray:
    per_word = 32 // bits
    shifts = np.arange(32 - bits, -1, -bits, dtype=np.uint32)
    words = (digits.reshape(len(digits), -1, per_word).astype(np.uint32) << shifts).sum(
        axis=2, dtype=np.uint32
    )
    if right_justify:
        rest = lengths % per_word
        rows = np.flatnonzero(rest)
        words[rows, lengths[rows] // per_word] >>= (bits * (per_word - rest[rows])).astype(np.uint32)
    return words


_BASE_DIGIT = np.zeros(256, np.uint8)
for _i, _base in enumerate(BASES):
    _BASE_DIGIT[ord(_base)] = _BASE_DIGIT[ord(_base.lower())] = _i
_BASE_CHAR = np.frombuffer(BASES.encode(), np.uint8)


def pack_pair(seq1: Column, qual1: Column, seq2: Column, qual2: Column, right_justify=False) -> Column:
    """The 120-byte record of a read pair, batch by batch."""

    @arrow_udf("binary")
    def packed_record(s1: pa.Array, q1: pa.Array, s2: pa.Array, q2: pa.Array) -> pa.Array:
        parts = []
        for seq, qual in ((s1, q1), (s2, q2)):
            chars, lengths = _slots(seq, BASE_WORDS * BASES_PER_WORD)
            parts.append(_to_words(_BASE_DIGIT[chars], 2, lengths, right_justify))
            chars, lengths = _slots(qual, QUAL_WORDS * QUALS_PER_WORD)
            good = (chars >= ord(GOOD_QUALITY[1])) & (chars <= ord(GOOD_QUALITY[3]))
            parts.append(_to_words(good, 1, lengths, right_justify))
        words = np.ascontiguousarray(np.hstack(parts).astype("<u4"))
        records = pa.FixedSizeBinaryArray.from_buffers(
            pa.binary(RECORD_BYTES), len(words), [None, pa.py_buffer(words)]
        )
        return records.cast(pa.binary())

    return packed_record(seq1, qual1, seq2, qual2)


PAIR_TYPE = "struct<barcode:bigint,seq1:string,qual1:string,seq2:string,qual2:string>"


def _texts(chars: np.ndarray) -> pa.Array:
    """A string of each row of a character matrix."""
    n, width = chars.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.StringArray.from_buffers(
        n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(chars))
    )


def unpack_pair(record: Column) -> Column:
    """Struct ``(barcode, seq1, qual1, seq2, qual2)``; the barcode is the first word as a number."""

    @arrow_udf(PAIR_TYPE)
    def unpacked_record(records: pa.Array) -> pa.Array:
        fixed = records.cast(pa.binary(RECORD_BYTES))
        words = np.frombuffer(fixed.buffers()[1], "<u4")[
            fixed.offset * RECORD_BYTES // 4:(fixed.offset + len(fixed)) * RECORD_BYTES // 4
        ].reshape(len(fixed), RECORD_BYTES // 4)

        def spread(first: int, count: int, bits: int) -> np.ndarray:
            shifts = np.arange(32 - bits, -1, -bits, dtype=np.uint32)
            values = words[:, first:first + count, None] >> shifts & np.uint32((1 << bits) - 1)
            return values.reshape(len(words), -1).astype(np.uint8)

        mate = BASE_WORDS + QUAL_WORDS
        columns = [pa.array(words[:, 0].astype(np.int64))]
        for first in (0, mate):
            columns.append(_texts(_BASE_CHAR[spread(first, BASE_WORDS, 2)]))
            columns.append(_texts(spread(first + BASE_WORDS, QUAL_WORDS, 1) + np.uint8(ord("0"))))
        return pa.StructArray.from_arrays(columns, ["barcode", "seq1", "qual1", "seq2", "qual2"])

    return unpacked_record(record)


def switch_base(barcode: Column, position: Column, base: Column) -> Column:
    """Replace the base at 0-based ``position``."""
    return F.overlay(barcode, base, position + 1, 1)
