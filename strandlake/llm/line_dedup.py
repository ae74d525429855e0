"""Near-duplicate lines by a join of deletion neighbourhoods; the earliest line stays.

Lines are compared by their words (A-Z in lower case, split at ASCII white space). Two lines match if their words are
equal, or if one edit in ``PARTS`` = 8 (one part inserted, dropped or replaced) makes them equal. What may be edited grows with
the line: a word, where the longer of the two has 8 or more; a code point of the words joined by blanks, where the shorter
has fewer words and the longer 8 or more code points; nothing in lines below that. So "Page 3 of 10" goes after "Page 2 of
10", and short lines that differ in a whole word stay. A line goes if a line before it, in order of id and line number,
matches it; lines without words always stay.

1. ``line_rows``: one pass over the texts gives each line's 128-bit hash and four hashes of its halves. Equal lines are
   grouped, so that a common line is one row.
2. One edit leaves one half as it is. Halves that more than one line has set bits in a filter of fixed size, and a
   second pass takes the lines that it lets through (some too many are harmless). The others match no line.
3. ``neighbourhoods``: the hash of such a line, and of the line without each of its words (code points; lines of a length
   between emit both). Again only hashes that more than one line has go on, by a filter of fixed size.
4. ``earliest``: lines that are equal without their part number ``i`` all match each other; a line matches each that
   equals it without some part. So the first line of every such group is offered to its members: an aggregation, in
   which no pairs are formed however large the group.
5. Offers are verified on the words of both lines.

Rows that repeat id and text are one document. A null id comes last; rows that share an id go by a hash of the text. Null and
empty texts have no lines, empty tables no rows. A very long line takes memory in proportion to its length; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import all_salts, map_batches, salt, text_bytes

PARTS = 8
FILTER_BITS = 26
_LINES_AT_ONCE = 50_000
_LAST = 2**63 - 1
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SIZE = 0xA0761D6478BD642F
_KINDS = (b"w", b"c")

_PLACE = ["doc_id", "text_key", "line_no"]
_HASH = ["h1", "h2"]


def _pair(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _longs(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)]


def lines_of(text: bytes | None) -> list[list[bytes]]:
    """Words of each line."""
    return [line.split() for line in (text or b"").lower().split(b"\n")]


def parts_of(words: list[bytes]) -> list[tuple[bytes, list[bytes]]]:
    """What is edited in a line, with its kind: words, code points, or either."""
    kinds = []
    if len(words) >= PARTS - 1:
        kinds.append((b"w", words))
    if len(words) <= PARTS and len(chars := b" ".join(words).decode()) >= PARTS - 1:
        kinds.append((b"c", [c.encode() for c in chars]))
    return kinds


def half_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of the halves of a line, as the shorter and as the longer of two lines."""
    halves = []
    for kind, parts in parts_of(words):
        glue = b" " if kind == b"w" else b""
        for n in (len(parts), len(parts) - 1):
            cut = n // 2
            for side, half in ((b"first", parts[:cut]), (b"last", parts[len(parts) - (n - cut):])):
                halves.append(xxhash.xxh64_intdigest(b"%b %b %d %b" % (kind, side, n, glue.join(half))))
    return np.array(halves, np.uint64).view(np.int64)


def cut_hashes(parts: list[bytes], kind: bytes = b"w") -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a line, and then of the line without each of its parts, in time that grows with the line.

    A line hashes to the sum of its parts' hashes times powers of a base; without a part, the later terms lose one power.
    """
    n = len(parts)
    sizes = np.full(n + 1, n - 1, np.uint64)
    sizes[0] = n
    hashes = []
    for seed, base in enumerate(_BASES):
        seed += 2 * _KINDS.index(kind)
        own = np.fromiter((xxhash.xxh64_intdigest(part, seed) for part in parts), np.uint64, n)
        powers = np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)))
        sums = np.append(np.uint64(0), np.cumsum(own * powers))
        cuts = sums[:-1] + (sums[-1:] - sums[1:]) * np.uint64(pow(base, -1, 2**64))
        hashes.append((np.append(sums[-1:], cuts) + sizes * np.uint64(_SIZE)).view(np.int64))
    return hashes[0], hashes[1]


def match(one: list[bytes], other: list[bytes]) -> bool:
    """Whether lines with these words match."""
    if max(len(one), len(other)) >= PARTS and within_one_edit(one, other):
        return True
    few = min(len(one), len(other)) < PARTS
    one, other = (b" ".join(words).decode() for words in (one, other))
    return few and max(len(one), len(other)) >= PARTS and within_one_edit(one, other)


def within_one_edit(one, other) -> bool:
    """Whether one part inserted, dropped or replaced makes two sequences equal, or they are."""
    least = min(len(one), len(other))
    same = next((i for i in range(least) if one[i] != other[i]), least)
    left = least - same
    back = next((i for i in range(left) if one[-1 - i] != other[-1 - i]), left)
    return max(len(one), len(other)) - same - back <= 1


def _key(id_col: str, text_col: str) -> Column:
    """Tells the texts of an id apart, and a null id from the largest."""
    return F.xxhash64(F.col(text_col).cast("string"), F.col(id_col).isNull())


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    number = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST))
    return docs.select(number.alias("doc_id"), _key(id_col, text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))


def line_rows(texts: DataFrame) -> DataFrame:
    """``(doc_id, text_key, line_no, h1, h2, halves)`` of every line with words."""

    def hashed(batches):
        for batch in batches:
            row, number, digests, halves = [], [], [], []
            for i, text in enumerate(text_bytes(batch.column(2))):
                for line_no, words in enumerate(lines_of(text)):
                    if words:
                        row.append(i)
                        number.append(line_no)
                        digests.append(_pair(b" ".join(words)))
                        halves.append(half_hashes(words))
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(number, pa.int64()), *_longs(digests),
                 pa.array(halves, pa.list_(pa.int64()))], names=[*_PLACE, *_HASH, "halves"],
            )

    return map_batches(
        texts, hashed, "doc_id bigint, text_key bigint, line_no bigint, h1 bigint, h2 bigint, halves array<bigint>"
    )


def _shared_bits(hashes: DataFrame, filter_bits: int) -> np.ndarray:
    """A bit for each value of the only column that more than one row has, at its slot in a filter of fixed size."""
    value = F.col(hashes.columns[0])
    shared = hashes.groupBy(value.alias("value")).agg(F.count("*").alias("n")).where("n > 1")
    words = shared.select(F.pmod("value", F.lit(1 << filter_bits)).alias("slot")).groupBy(
        F.shiftright("slot", 6).alias("word")
    ).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("mask"))
    found = words.toArrow()  # at most 2 ** (filter_bits - 6) rows
    bits = np.zeros(1 << (filter_bits - 6), np.int64)
    bits[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return bits


def _is_set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slots = values % (len(bits) * 64)
    return (bits[slots >> 6] >> (slots & 63)) & 1 == 1


_PLACE_TYPE = "struct<doc_id:bigint,text_key:bigint,line_no:bigint>"


def _places(places: list[tuple[int, int, int]]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([p[i] for p in places], pa.int64()) for i in range(3)], _PLACE)


def candidate_lines(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """``(h1, h2, place, line)`` of each distinct line with a half whose bit is set, at its first place."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def batch_of(held):
        return pa.RecordBatch.from_arrays(
            [*_longs(list(held)), _places([place for place, _ in held.values()]),
             pa.array([line for _, line in held.values()], pa.binary())], names=[*_HASH, "place", "line"],
        )

    def search(batches):
        known = shared.value
        held: dict[bytes, tuple] = {}
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, key, text in zip(ids, keys, text_bytes(batch.column(2)), strict=True):
                for line_no, words in enumerate(lines_of(text)):
                    if words and _is_set(known, half_hashes(words)).any():
                        line, place = b" ".join(words), (doc, key, line_no)
                        digest = _pair(line)
                        if digest not in held or place < held[digest][0]:
                            held[digest] = (place, line)
                        if len(held) >= _LINES_AT_ONCE:
                            yield batch_of(held)
                            held = {}
        if held:
            yield batch_of(held)

    rows = map_batches(texts, search, f"h1 bigint, h2 bigint, place {_PLACE_TYPE}, line binary")
    # tasks may have met the same line
    return rows.groupBy(*_HASH).agg(F.min("place").alias("place"), F.max("line").alias("line"))


def _variant_keys(batches):
    for batch in batches:
        keys = [np.unique(cut_hashes(parts, kind)[0]) for line in batch.column(0) for kind, parts in parts_of(line.as_py().split())]
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], names=["v1"])


def neighbourhoods(lines: DataFrame, bits: np.ndarray) -> DataFrame:
    """``(v1, v2, cut, h1, h2, place, line)``: a hash without part ``cut``, if its bit is set; ``cut`` -1 is the whole
    line, once with its words."""
    shared = lines.sparkSession.sparkContext.broadcast(bits)

    def emit(batches):
        for batch in batches:
            row, cuts, first, second, bare = [], [], [], [], []
            for i, line in enumerate(batch.column(3)):
                for number, (kind, parts) in enumerate(parts_of(line.as_py().split())):
                    one, other = cut_hashes(parts, kind)
                    keep = _is_set(shared.value, one)
                    keep[0] = True
                    some = np.flatnonzero(keep)
                    row.append(np.full(len(some), i))
                    cuts.append(some - 1)
                    first.append(one[some])
                    second.append(other[some])
                    bare.append((some > 0) | (number > 0))
            if not row:
                continue
            row, cuts = np.concatenate(row), np.concatenate(cuts)
            taken = pa.array(row)
            texts = batch.column(3).take(pa.array(row, pa.int64(), mask=np.concatenate(bare)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(first)), pa.array(np.concatenate(second)), pa.array(cuts),
                 *(batch.column(j).take(taken) for j in range(3)), texts],
                names=["v1", "v2", "cut", *_HASH, "place", "line"],
            )

    return map_batches(
        lines, emit, f"v1 bigint, v2 bigint, cut bigint, h1 bigint, h2 bigint, place {_PLACE_TYPE}, line binary"
    )


def earliest(near: DataFrame) -> DataFrame:
    """``(h1, h2, f1, f2)``: the first line, before this one, that is offered to it."""
    near = near.select("v1", "v2", "cut", F.struct("place", *_HASH).alias("own"))
    whole = near.where("cut < 0").select("v1", "v2", F.col("own").alias("first"))
    cuts = near.where("cut >= 0")

    def offered(groups: DataFrame, keys: list[str], to: DataFrame) -> DataFrame:
        dealt = groups.select(*keys, "first", all_salts().alias("salt"))
        return to.withColumn("salt", salt("own.h1", "own.h2")).join(dealt, [*keys, "salt"]).select("own", "first")

    by_cut = cuts.groupBy("v1", "v2", "cut").agg(F.min("own").alias("first"), F.count("*").alias("n")).where("n > 1")
    by_rest = cuts.groupBy("v1", "v2").agg(F.min("own").alias("first"))
    offers = offered(by_cut, ["v1", "v2", "cut"], cuts)
    offers = offers.unionByName(offered(whole, ["v1", "v2"], cuts))
    offers = offers.unionByName(whole.select("v1", "v2", F.col("first").alias("own")).join(by_rest, ["v1", "v2"]).select("own", "first"))
    before = offers.where("first.place < own.place").groupBy("own.h1", "own.h2").agg(F.min("first").alias("first"))
    return before.select(*_HASH, F.col("first.h1").alias("f1"), F.col("first.h2").alias("f2"))


def _verified(offers: DataFrame, near: DataFrame) -> DataFrame:
    """``(h1, h2)`` of lines whose offered line is within one edit."""

    def check(batches):
        for batch in batches:
            one, other = (batch.column(i).to_pylist() for i in (2, 3))
            close = [match(a.split(), b.split()) for a, b in zip(one, other, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(close, pa.bool_())) for c in batch.columns[:2]], names=_HASH)

    lines = near.where("line IS NOT NULL").select(*_HASH, "line")
    first = lines.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.col("line").alias("first"))
    pairs = offers.join(lines, _HASH).join(first, ["f1", "f2"]).select(*_HASH, "line", "first")
    return map_batches(pairs, check, "h1 bigint, h2 bigint")


def kept_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS
) -> DataFrame:
    """``(id_col, text_key, kept)`` of every row: numbers, from 0, of the lines with words that stay, in order."""
    texts = _keyed(docs, id_col, text_col)
    lines = line_rows(texts).groupBy(*_HASH).agg(
        F.min(F.struct(*_PLACE)).alias("place"), F.first("halves").alias("halves")
    )
    lines = cut_lineage(lines)
    halves = lines.select(F.explode("halves").alias("half"))
    some = cut_lineage(candidate_lines(texts, _shared_bits(halves, filter_bits)))
    keys = map_batches(some.select("line"), _variant_keys, "v1 bigint")
    near = cut_lineage(neighbourhoods(some, _shared_bits(keys, filter_bits)))
    gone = _verified(cut_lineage(earliest(near)), near)
    stay = lines.join(gone, _HASH, "left_anti").select("place.*")
    stay = stay.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("line_no")).alias("kept"))
    rows = docs.select(
        F.col(id_col), F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("__id"),
        _key(id_col, text_col).alias("text_key"),
    )
    stay = stay.select(F.col("doc_id").alias("__id"), "text_key", "kept")
    return rows.join(stay, ["__id", "text_key"], "left").select(
        id_col, "text_key", F.coalesce("kept", F.array().cast("array<bigint>")).alias("kept")
    )


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with only the lines that stay, and those without words, in their texts."""
    kept = kept_lines(docs, id_col, text_col).distinct()
    kept = kept.select(F.col(id_col).alias("__id"), F.col("text_key").alias("__key"), F.col("kept").alias("__kept"))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (_key(id_col, text_col) == F.col("__key"))
    lines = F.split(text_col, "\n", -1)
    some = F.filter(lines, lambda line, i: ~F.rlike(line, F.lit(r"[^ \t\x0b\f\r]")) | F.array_contains("__kept", i.cast("bigint")))
    return docs.join(kept, same).withColumn(text_col, F.array_join(some, "\n")).select(*docs.columns)
