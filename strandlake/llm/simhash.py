"""Near duplicates by SimHash fingerprints, compared bit-sliced.

Fingerprint: of all runs of three words (A-Z in lower case, split at ASCII white space, joined by one space,
repeats included; a shorter text: the whole sequence) XXH64 with seed 42 is taken; a bit is 1 if it is set
in over half of them. A text without words, or null, has fingerprint 0 and is linked like any other.
Fingerprints that differ in at most ``RADIUS`` = 2 bits are linked; a component is everything reachable.

Search, over distinct fingerprints only (copies are one row, however many there are):

* Two differing bits touch at most two of the eight bytes, so linked fingerprints agree in six. Each
  fingerprint goes to 28 buckets, one for each choice of six bytes. The other two bytes leave at most 65,536
  different fingerprints to a bucket, whatever the input: a bound that holds for any group of near copies.
* Within a bucket the 16 open bits are stored as bit planes, 64 fingerprints to a word. A word of distances is
  counted at once with carry-save counters, and dropped as soon as all its 64 exceed the radius.
* A bucket returns links to the lowest member of each of its groups, so links grow with the members.

Ids are taken as they are: rows that share an id and differ in text each have their fingerprint. A null id
counts as higher than any other when the smallest of a component is taken. Other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import all_salts, map_batches, salt, text_bytes
from .components import components

WORDS = 3
SEED = 42
RADIUS = 2
#: The pairs of bytes that a bucket leaves open.
OPEN_BYTES = list(combinations(range(8), 2))

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_HASHES_AT_ONCE = 1 << 18
_ROWS_AT_ONCE = 1 << 16
_WORDS_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, n_words: int = WORDS) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) < n_words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    shingles = [joined[a:b] for a, b in zip(starts, ends[n_words - 1:], strict=False)]
    return list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)))


def fingerprint(text: bytes | None) -> int:
    """As a signed number, as Spark stores it."""
    hashes = np.array(shingle_hashes(text or b""), dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[at:at + _HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprint_batches(batches):
    for batch in batches:
        prints = [fingerprint(text) for text in text_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints, pa.int64())], names=["id", "fp"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, _fingerprint_batches, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let linked members have one label, the lowest; ``label`` points at final labels before and after."""
    while True:
        low, high = label[a], label[b]
        apart = low != high
        if not apart.any():
            return
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(label, np.maximum(low, high), np.minimum(low, high))
        while (label[label] != label).any():
            label[:] = label[label]


def _lanes(n) -> np.ndarray:
    """Words whose lowest ``n`` bits are set, ``n`` from 0 to 64."""
    n = n.astype(np.uint64)
    return np.where(n >= 64, _ALL, (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))


def _within_radius(planes, bits, row, block, valid):
    """Of ``row`` against the 64 lanes of ``block``: the words that keep a lane, and those lanes."""
    ones, twos, over = np.zeros_like(valid), np.zeros_like(valid), ~valid
    for p, plane in enumerate(planes):
        differ = plane[block] ^ (np.uint64(0) - ((bits[row] >> np.uint64(p)) & np.uint64(1)))
        carry = ones & differ
        ones ^= differ
        twos ^= carry
        over |= (ones & twos) | (carry & ~twos)  # three, or beyond
        if p % 4 == 3:
            keep = over != _ALL
            row, block, ones, twos, over = row[keep], block[keep], ones[keep], twos[keep], over[keep]
    return row, block, ~over


def bucket_links(table: np.ndarray, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(member, lowest member of its group)`` in complete buckets, which are sorted runs of rows."""
    n = len(fp)
    new = np.ones(n, bool)
    new[1:] = (table[1:] != table[:-1]) | (key[1:] != key[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    shared = np.repeat(sizes > 1, sizes)
    if not shared.any():
        return fp[:0], fp[:0]
    fp, table, sizes = fp[shared], table[shared], sizes[sizes > 1]
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = len(fp)
    opened = np.array(OPEN_BYTES, dtype=np.uint64)[table] * np.uint64(8)
    unsigned = fp.view(np.uint64)
    low, high = ((unsigned >> opened[:, i]) & np.uint64(255) for i in (0, 1))
    bits = low | (high << np.uint64(8))
    padded = np.zeros((n + 63) // 64 * 64, np.uint64)
    padded[:n] = bits
    planes = [
        np.packbits(((padded >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8")
        for p in range(16)
    ]
    label = np.arange(n)
    rows = np.flatnonzero(np.arange(n) > first)  # each against the members before it
    blocks = (rows - 1) // 64 - first[rows] // 64 + 1
    at, done = 0, np.cumsum(blocks)
    while at < len(rows):
        base = done[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(done, base + _WORDS_AT_ONCE, side="right")))
        some, many = rows[at:to], blocks[at:to]
        row = np.repeat(some, many)
        step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        block = first[row] // 64 + step
        valid = _lanes(np.clip(row - block * 64, 0, 64)) & ~_lanes(np.clip(first[row] - block * 64, 0, 64))
        row, block, lanes = _within_radius(planes, bits, row, block, valid)
        hit, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        _join_labels(label, row[hit], block[hit] * 64 + lane)
        at = to
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def _link_batches(batches):
    """Rows come sorted by bucket; a bucket is held until its last row has come."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def links(last: bool):
        nonlocal held, rows
        table, key, fp = (
            np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3)
        )
        complete = len(fp)
        if not last:
            ends = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1]))
            complete = int(ends[-1]) + 1 if len(ends) else 0
        rest = [table[complete:], key[complete:], fp[complete:]]
        types = held[0].schema
        held = [pa.RecordBatch.from_arrays([pa.array(x) for x in rest], schema=types)]
        rows = len(fp) - complete
        u, v = bucket_links(table[:complete], key[:complete], fp[:complete])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _ROWS_AT_ONCE:
            yield links(last=False)
    if held:
        yield links(last=True)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links ``(u, v)`` whose components are those of all fingerprints within the radius; ``prints(fp)`` distinct."""
    masks = [sum(255 << (8 * b) for b in range(8) if b not in pair) for pair in OPEN_BYTES]
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint") for m in masks])
    buckets = prints.select(F.posexplode(masks).alias("table", "mask"), "fp").select(
        F.col("table").cast("bigint").alias("table"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )
    dealt = buckets.repartition("table", "key").sortWithinPartitions("table", "key", "fp")
    return map_batches(dealt, _link_batches, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fingerprint, component_id)`` of every row; ``component_id`` is the smallest id reachable."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col).withColumn("salt", salt("id")))
    # a fingerprint of very many copies is dealt over its salts
    parts = cut_lineage(rows.groupBy("fp", "salt").agg(F.min("id").alias("low")))
    prints = cut_lineage(parts.groupBy("fp").agg(F.min("low").alias("low")))
    members = components(fingerprint_links(prints.select("fp"))).withColumnRenamed("node", "fp")
    members = cut_lineage(members.join(prints, "fp"))
    lows = members.groupBy("root").agg(F.min("low").alias("component_id"))
    hubs = members.select("root", salt("fp").alias("hub")).distinct().join(lows, "root")
    grouped = members.withColumn("hub", salt("fp")).join(hubs, ["root", "hub"]).select("fp", "component_id")
    classes = prints.join(grouped, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    classes = parts.select("fp", "salt").join(classes, "fp")
    return rows.join(classes, ["fp", "salt"]).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_surplus(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one document of each group: the lowest id, nulls last, then the lowest hash of the text.

    ``members(id, text_key, group)`` has a row for each row of ``docs``; rows that repeat id and text are one document.
    """
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "text_key")
    firsts = members.groupBy("group").agg(F.min(rank).alias("first"), F.max(rank).alias("end")).where("first <> end")
    dealt = firsts.select("group", "first", all_salts().alias("salt"))
    # the copies for all salts are not to be broadcast
    grouped = members.withColumn("salt", salt("id", "text_key")).join(dealt.hint("merge"), ["group", "salt"])
    gone = grouped.where(rank != F.col("first")).select(F.col("id").alias("__gone"), F.col("text_key").alias("__gone_key"))
    text_key = F.xxhash64(F.col(text_col).cast("string"))
    same = F.col(id_col).eqNullSafe(F.col("__gone")) & (text_key == F.col("__gone_key"))
    return docs.join(gone.distinct(), same, "left_anti")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of ``docs`` that are the first of their component, as ``drop_surplus`` says."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def hashed(batches):
        for batch in batches:
            prints = [fingerprint(text) for text in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints, pa.int64())], names=["id", "text_key", "fp"]
            )

    keyed = rows.select("id", F.xxhash64("text").alias("text_key"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    members = cut_lineage(map_batches(keyed, hashed, f"id {kind}, text_key bigint, fp bigint"))
    roots = components(fingerprint_links(cut_lineage(members.select("fp").distinct()))).withColumnRenamed("node", "fp")
    members = members.join(roots, "fp", "left").select("id", "text_key", F.coalesce("root", "fp").alias("group"))
    return drop_surplus(docs, members, id_col, text_col)
