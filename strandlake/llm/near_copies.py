"""Near copies by wide SimHash fingerprints of five-word runs, compared bit-sliced.

A text is the set of its runs of ``WORDS`` = 5 words (words and short texts as in ``simhash``). Its fingerprint has ``BITS``
= 256 bits; a bit is 1 if it is set in the hashes of over half of the set. Sets of similarity (Jaccard) 0.8 differ in 15 %
of the bits, 39 of 256 on average, sets of 0.9 in 10 %. Documents whose fingerprints differ in at most ``RADIUS`` bits are
linked; a group is everything reachable.

Search, over distinct fingerprints only:

* Each goes to ``len(TABLES)`` bucket tables, whose keys are two of its bytes. Two fingerprints that differ in a share ``p``
  of their bits meet in one with a probability of ``1 - (1 - (1 - p) ** 16) ** len(TABLES)``: 0.95 at a similarity of 0.8,
  0.999 at 0.9. A bucket has one fingerprint in 65,536 where texts are unlike, so that work grows with the square of the
  input beyond some hundred million texts; longer keys and more tables are then due.
* Within a bucket the fingerprints are stored as bit planes, 64 to a word. Distances are counted for a word at a time, with
  carry-save counters that start so that they overflow just beyond the radius; a word is dropped as soon as all its 64 have.
* Members that are of one group already are not compared. So the first ``FIRST_TABLES`` tables are searched alone; each
  member's lowest neighbour in them is its root in the others, where a large group of copies costs no more than one member. In every bucket, members are
  first compared with its first 64.
* A bucket returns one link for each group that it joins to another.

Texts without words, and null, are alike. The document that stays is that of ``simhash.drop_surplus``: of each group the lowest
id, nulls last. Rows that repeat id and text are one document, rows that share an id and differ in text are not. Empty tables
stay empty. A very long text takes memory in proportion to its length; other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_batches, text_bytes
from .components import components
from .simhash import _ALL, _join_labels, _lanes, drop_surplus, shingle_hashes

WORDS = 5
BITS = 256
RADIUS = 44
#: The bytes of a fingerprint that are the key of a table.
TABLES = [(i, (i + step) % 32) for step in (1, 5) for i in range(32)][:40]
FIRST_TABLES = 4

_LONGS = BITS // 64
_COUNTER_BITS = 6
_SPREAD = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1) for i in range(_LONGS)]
_SHIFT = np.uint64(32)
_HASHES_AT_ONCE = 1 << 16
_ROWS_AT_ONCE = 1 << 16
_WORDS_AT_ONCE = 1 << 14


def fingerprint(text: bytes | None) -> bytes:
    hashes = np.unique(np.array(shingle_hashes(text or b"", WORDS), np.uint64))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[at:at + _HASHES_AT_ONCE, None] * np.array(_SPREAD)
        part = (part ^ (part >> _SHIFT)) * _SPREAD[1]
        part ^= part >> _SHIFT
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes()


def node_of(fp: bytes) -> int:
    return xxhash.xxh64_intdigest(fp) - (1 << 63)


def _members(texts: DataFrame) -> DataFrame:
    """``(id, text_key, fp, node)`` of every row; ``node`` stands for the fingerprint."""

    def hashed(batches):
        for batch in batches:
            prints = [fingerprint(text) for text in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(map(node_of, prints), pa.int64())],
                names=["id", "text_key", "fp", "node"],
            )

    kind = texts.schema["id"].dataType.simpleString()
    return map_batches(texts, hashed, f"id {kind}, text_key bigint, fp binary, node bigint")


def _planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (rows of longs), 64 fingerprints to a word."""
    n = len(prints)
    bits = np.zeros(((n + 63) // 64 * 64, BITS), np.uint8)
    bits[:n] = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _close(planes, prints, row, block, valid):
    """Of ``row`` against the 64 lanes of ``block``: the words that keep a lane, and those lanes."""
    ahead = (1 << _COUNTER_BITS) - 1 - RADIUS
    over = ~valid
    counters = [np.full_like(valid, _ALL if ahead >> i & 1 else 0) for i in range(_COUNTER_BITS)]
    for p in range(0, BITS, 2):
        one, other = (
            planes[q, block] ^ (np.uint64(0) - ((prints[row, q >> 6] >> np.uint64(q & 63)) & np.uint64(1))) for q in (p, p + 1)
        )
        # the lowest counter takes both, and passes one carry on
        ones = counters[0]
        carry = (one & other) | (ones & (one ^ other))
        counters[0] = ones ^ one ^ other
        for i in range(1, _COUNTER_BITS):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if p % 16 == 14 and p > RADIUS:
            keep = over != _ALL
            if not keep.all():
                row, block, over = row[keep], block[keep], over[keep]
                counters = [c[keep] for c in counters]
            if not len(row):
                break
    return row, block, ~over


def _compare(planes, prints, label, rows, begin, end):
    """Join the labels of each of ``rows`` with those of close members from ``begin`` to before ``end``."""
    blocks = np.where(end > begin, (end - 1) // 64 - begin // 64 + 1, 0)
    done = np.cumsum(blocks)
    at = 0
    while at < len(rows):
        base = done[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(done, base + _WORDS_AT_ONCE, side="right")))
        many = blocks[at:to]
        row = np.repeat(rows[at:to], many)
        first, last = np.repeat(begin[at:to], many), np.repeat(end[at:to], many)
        block = first // 64 + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        valid = _lanes(np.clip(last - block * 64, 0, 64)) & ~_lanes(np.clip(first - block * 64, 0, 64))
        row, block, lanes = _close(planes, prints, row, block, valid)
        hit, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        _join_labels(label, row[hit], block[hit] * 64 + lane)
        at = to


def _runs(*columns: np.ndarray) -> np.ndarray:
    """For each row the first row of its run of equal values."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def bucket_links(bucket: np.ndarray, root: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between roots, in complete buckets whose rows stand together and are sorted by root."""
    first = _runs(bucket)
    known = _runs(bucket, root)
    several = np.bincount(first, known != first, len(first))[first] > 0  # buckets with more than one root
    bucket, root, prints = bucket[several], root[several], prints[several]
    if not len(root):
        return root, root
    first = _runs(bucket)
    label = _runs(bucket, root)
    size = np.bincount(first, minlength=len(first))[first]
    rows = np.arange(len(root))
    planes = _planes(prints)
    # with the first 64 of the bucket
    late = np.flatnonzero((rows > first) & (size > 64))
    _compare(planes, prints, label, late, first[late], np.minimum(first[late] + 64, late))
    # members of one group stand together from here on
    order = np.lexsort((label, first))
    place = np.empty_like(order)
    place[order] = rows
    label, prints, root = place[label[order]], prints[order], root[order]
    planes = _planes(prints) if (order != rows).any() else planes
    began = _runs(first, label)
    _compare(planes, prints, label, rows, first, began)
    joined = np.flatnonzero(root != root[label])
    links = np.unique(np.stack([root[joined], root[label[joined]]], axis=1), axis=0)
    return links[:, 0].copy(), links[:, 1].copy()


def _link_batches(batches):
    """Rows ``(bucket, root, fp)`` come sorted; a bucket is held until its last row has come."""
    held, rows = [], 0

    def links(last: bool):
        nonlocal held, rows
        bucket, root, prints = (np.concatenate([c[i] for c in held]) for i in range(3))
        complete = len(root)
        if not last:
            ends = np.flatnonzero(bucket[1:] != bucket[:-1])
            complete = int(ends[-1]) + 1 if len(ends) else 0
        held = [(bucket[complete:], root[complete:], prints[complete:])]
        rows = len(root) - complete
        u, v = bucket_links(bucket[:complete], root[:complete], prints[:complete])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    wait = _ROWS_AT_ONCE
    for batch in batches:
        prints = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, _LONGS)
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), prints))
        rows += batch.num_rows
        if rows >= wait:
            yield links(last=False)
            wait = max(_ROWS_AT_ONCE, 2 * rows)
    if held:
        yield links(last=True)


def fingerprint_links(prints: DataFrame, tables: list[tuple[int, int]]) -> DataFrame:
    """Links ``(u, v)`` between the roots of ``prints(fp, root)`` that have members within the radius."""
    places = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j")) for i, j in tables])
    buckets = prints.select("fp", "root", F.posexplode(places).alias("table", "at"))
    key = F.concat(F.substring("fp", F.col("at.i"), F.lit(1)), F.substring("fp", F.col("at.j"), F.lit(1)))
    number = F.col("table") * 65536 + F.conv(F.hex(key), 16, 10).cast("int")
    dealt = buckets.select(number.alias("bucket"), "root", "fp").repartition("bucket").sortWithinPartitions("bucket", "root")
    return cut_lineage(map_batches(dealt, _link_batches, "u bigint, v bigint").distinct())


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_key, group)`` of every row."""
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    members = cut_lineage(_members(texts))
    prints = members.groupBy("node").agg(F.first("fp").alias("fp"))
    links = fingerprint_links(prints.select("fp", F.col("node").alias("root")), TABLES[:FIRST_TABLES])
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    rooted = prints.join(lowest, "node", "left").select("fp", F.least("node", "root").alias("root"))
    links = links.unionByName(fingerprint_links(rooted, TABLES[FIRST_TABLES:]))
    groups = components(links)
    return members.join(groups, "node", "left").select("id", "text_key", F.coalesce("root", "node").alias("group"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of ``docs``."""
    return drop_surplus(docs, near_copies(docs, id_col, text_col), id_col, text_col)
