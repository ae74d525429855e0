"""Clustering the hashes of each barcode into molecules.

For every barcode the *good* hashes (those in the depth range) are numbered by ascending depth. A
good hash joins the cluster of the earlier good hash through which most of the barcodes sharing it
were first met.

* Pairs of barcodes are never rows: a good hash travels to its barcodes, once, with the list of the others that carry it, which
  the range bounds, as steps between ascending numbers of seven bits a byte. First meetings and their counts are then found for many barcodes at once, as columns of an Arrow batch.
* Barcodes of up to ``PAIRS`` pairs are numbered, tallied, clustered and united where their rows meet (``_labels_of``). The lists
  travel to one slice of the barcodes after the other, so that the disks hold those of a slice.
* A barcode with more than ``PAIRS`` pairs is cut by the other barcode, and its counts are added up by barcode and hash. Its numbers
  come from sampled ranges that cut it (``ranks.grouped_rank``); clusters are found on the hashes that join one, and united on the
  reads that lie in several: small tables. This goes by slices of these barcodes as well.
* Tables of the size of the input are written as compressed blocks.

So neither a large barcode nor one with many clusters meets in one row or task. The pairs of barcodes formed are bounded
by the range: a hash in the range ``[low, high)`` is carried by fewer than ``high`` barcodes.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.blocks import ROWS, SCHEMA, as_batch, block_of, pack_batches, tables_in
from ..session import cut_lineage, cut_lineage_packed, give_up, unpacked
from . import histogram as hist
from .incidence import hash_depths, in_range
from .ranks import grouped_rank, running_sum

# Fixed value: the support a hash needs to join a cluster.
DEFAULT_THRESHOLD = 5
#: Pairs of a barcode and another on some good hash that one task takes.
PAIRS = 4_000_000

#: Pairs of a slice of the barcodes, and the most slices, each of which reads all lists.
SLICE_PAIRS = 250_000_000
SLICES = 8

_PAIRS_AT_ONCE = 1_000_000
_BYTES_AT_ONCE = 16 << 20
_TALLY = ["barcode", "i", "ms", "n", "parent", "total", "whole"]
_TALLY_SCHEMA = "barcode bigint, i int, ms int, n bigint, parent int, total bigint, whole boolean"
_ROWS_SCHEMA = "barcode bigint, depth bigint, hash bigint, read bigint, others binary"
_LABELS_SCHEMA = "barcode bigint, hash bigint, read bigint, depth bigint, i int, raw int, sub int, share double"


def carriers(inc: DataFrame, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """``(hash, depth, members)``: barcodes and reads of each in-range hash, a list its range bounds."""
    ranged = in_range(hash_depths(inc), ranges)
    member = F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("barcode", "read")])
    return inc.join(ranged, "hash").groupBy(F.col("hash").cast("bigint").alias("hash"), "depth").agg(
        F.collect_list(member).alias("members")
    )


def _good(inc: DataFrame, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """``(barcode, hash, read, depth)``: the in-range hashes of every barcode."""
    rows = inc.join(in_range(hash_depths(inc), ranges), "hash")
    return rows.select(*[F.col(c).cast("bigint").alias(c) for c in ("barcode", "hash", "read")], "depth")


def _numbered(good: DataFrame) -> DataFrame:
    return grouped_rank(good, ["barcode"], ["depth", "hash"], "i").withColumn("i", (F.col("i") - 1).cast("int"))


def good_hashes(inc: DataFrame, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """``(barcode, hash, read, depth, i)``: the in-range hashes of every barcode, numbered from 0."""
    return _numbered(_good(inc, ranges))


def _packed(lists: pa.ListArray) -> pa.BinaryArray:
    """Lists of ascending numbers as their steps, seven bits a byte, of which all but the last of a step have the top bit."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy()[offsets[0]:offsets[-1]].view(np.uint64)
    offsets = offsets - offsets[0]
    steps = values.copy()
    steps[1:] -= values[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    steps[firsts] = values[firsts]
    size = 1 + sum((steps >> np.uint64(7 * k) > 0).astype(np.int64) for k in range(1, 10))
    ends = np.append(0, np.cumsum(size))
    data = np.zeros(ends[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        low = (steps[on] >> np.uint64(7 * k)) & np.uint64(127)
        data[ends[on] + k] = low + np.where(size[on] > k + 1, 128, 0).astype(np.uint64)
    return pa.Array.from_buffers(
        pa.binary(), len(lists), [None, pa.py_buffer(ends[offsets].astype(np.int32)), pa.py_buffer(data)]
    )


def _unpacked(packed: pa.BinaryArray) -> pa.ListArray:
    """The lists of :func:`_packed`; empty ones for nulls."""
    packed = packed.cast(pa.binary()).fill_null(b"")
    _, offsets, data = packed.buffers()
    offsets = np.frombuffer(offsets, np.int32)[packed.offset:packed.offset + len(packed) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]]
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends + 1)[:-1]
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    low = (data & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    upto = np.append(np.uint64(0), np.cumsum(np.add.reduceat(low, starts) if len(starts) else low))
    lists = np.searchsorted(ends, offsets - offsets[0])
    values = upto[1:] - np.repeat(upto[lists[:-1]], np.diff(lists))
    return pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.array(values.view(np.int64)))


def _pack_udf():
    """Column function: a list of ascending numbers, packed."""

    @arrow_udf("binary")
    def pack_steps(lists: pa.Array) -> pa.Array:
        return _packed(lists)

    return pack_steps


def _by_group(group: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order by ``group``, then ``other``, and where in it a new pair of them begins.

    Both and the place are sorted as one number where they fit, which is several times faster.
    """
    n = len(group)
    if n:
        low, least = int(group.min()), int(other.min())
        bits = int(n - 1).bit_length()
        other_bits = (int(other.max()) - least).bit_length()
        if (int(group.max()) - low).bit_length() + other_bits + bits <= 63:
            key = (((group - low).astype(np.int64) << other_bits) | (other - least)) << bits
            key |= np.arange(n)
            key.sort()
            order = key & ((1 << bits) - 1)
            key >>= bits
            return order, np.append(True, key[1:] != key[:-1])
    order = np.lexsort((other, group))
    new = np.ones(n, bool)
    new[1:] = (other[order][1:] != other[order][:-1]) | (group[order][1:] != group[order][:-1])
    return order, new


def _meetings_of(group: np.ndarray, own: np.ndarray, i: np.ndarray, others: pa.ListArray):
    """``(row, ms, n)``, by row and ``ms``: of the barcodes in ``others`` of a row, ``n`` were first met on the earlier ``ms``.

    Rows of a ``group`` stand together, by ``i``; a barcode does not meet its own.
    """
    row = np.repeat(np.arange(len(i)), np.diff(others.offsets.to_numpy()))
    other = others.flatten().to_numpy()
    met = other != own[row]
    row, other = row[met], other[met]
    order, new = _by_group(group[row], other)
    at = np.flatnonzero(new)
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(i[row[order[at]]], np.diff(np.append(at, len(order))))
    later = first < i[row]
    key, n = np.unique((row[later] << 32) | first[later], return_counts=True)
    return key >> 32, key & ((1 << 32) - 1), n


def _tally_batches(batches, threshold: int):
    """Rows ``(barcode, part, parts, i, others, packed)`` come by barcode, part and ``i``; a group is held until its last row came.

    Other barcodes are packed, or the list where ``packed`` is null.
    """
    held: list[pa.RecordBatch] = []
    pairs = 0

    def tally(last: bool):
        nonlocal held, pairs
        rows = pa.Table.from_batches(held).combine_chunks()
        barcode, part, parts, i = (rows.column(k).to_numpy() for k in range(4))
        new = np.ones(len(i), bool)
        new[1:] = (barcode[1:] != barcode[:-1]) | (part[1:] != part[:-1])
        done = len(i) if last else int(np.flatnonzero(new)[-1])
        held = rows.slice(done).to_batches()
        pairs = sum(len(b.column(4).flatten()) for b in held)
        others = rows.slice(0, done).column(4)
        others = others.chunk(0) if others.num_chunks else pa.array([], others.type)
        row, ms, n = _meetings_of(np.cumsum(new)[:done], barcode[:done], i[:done].astype(np.int64), others)
        # count and place in one number, the highest of which is the largest count at the earliest place
        packed = (n << 32) | ((1 << 32) - 1 - ms)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        best, total = np.zeros(done, np.int64), np.zeros(done, np.int64)
        if len(starts):
            best[row[starts]] = np.maximum.reduceat(packed, starts)
            total[row[starts]] = np.add.reduceat(n, starts)
        keep = (best[row] >> 32 >= threshold) | (parts[row] > 1)
        row, ms, n = row[keep], ms[keep], n[keep]
        parent = (1 << 32) - 1 - (best[row] & ((1 << 32) - 1))
        return pa.RecordBatch.from_arrays(
            [pa.array(barcode[row]), pa.array(i[row].astype(np.int32)), pa.array(ms.astype(np.int32)), pa.array(n),
             pa.array(parent.astype(np.int32)), pa.array(total[row]), pa.array(parts[row] == 1)], names=_TALLY,
        )

    for batch in batches:
        if batch.num_rows:
            others, packed = batch.column(4), batch.column(5)
            lists = _unpacked(packed)
            if packed.null_count:
                lists = pc.if_else(packed.is_valid(), lists, others.cast(lists.type))
            held.append(pa.RecordBatch.from_arrays([*batch.columns[:4], lists], names=batch.schema.names[:5]))
            pairs += len(lists.flatten())
        if pairs >= _PAIRS_AT_ONCE:
            yield tally(last=False)
    if held:
        yield tally(last=True)


def _joined(good: DataFrame, mine: DataFrame, start: int, threshold: int) -> DataFrame:
    """``(barcode, i, ms, n, parent, total)``: first meetings of the good hashes of ``mine`` that join a cluster.

    Of the ``total`` other barcodes on such a hash that were met before, ``n`` were first met on the earlier good hash
    ``ms``; it joins ``parent``, the first of those with the largest ``n``, which is at least ``threshold``. Good hashes before
    ``start`` are not looked at.
    """
    members = good.groupBy("hash").agg(F.sort_array(F.collect_list("barcode")).alias("others"))
    members = members.select("hash", "others", _pack_udf()("others").alias("packed"))
    rows = mine.where(F.col("i") >= start)
    sizes = rows.groupBy("barcode").agg(F.ceil(F.sum("depth") / PAIRS).cast("int").alias("parts")).where("parts > 1")
    # parts are known before the lists are added, so that those travel once
    rows = rows.select("barcode", "hash", "i").join(sizes, "barcode", "left").join(members, "hash")
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.select("barcode", parts.alias("parts"), "i", "others", "packed", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    whole = F.col("parts") == 1
    mine_of = F.filter("others", lambda b: F.pmod(F.xxhash64(b), F.col("parts").cast("bigint")) == F.col("part"))
    rows = rows.select("barcode", "part", "parts", "i", F.when(~whole, mine_of).alias("others"), F.when(whole, F.col("packed")).alias("packed"))
    dealt = rows.repartition("barcode", "part").sortWithinPartitions("barcode", "part", "i")
    # no null lists: Arrow's writer goes over all of a batch that precede a null one once more
    dealt = dealt.withColumn("others", F.coalesce("others", F.array().cast("array<bigint>")))
    tallies = cut_lineage(dealt.mapInArrow(lambda batches: _tally_batches(batches, threshold), _TALLY_SCHEMA))
    whole = tallies.where("whole").drop("whole")
    # of barcodes that were cut
    cut = tallies.where("NOT whole").groupBy("barcode", "i", "ms").agg(F.sum("n").alias("n"))
    packed = F.col("n") * (1 << 32) + ((1 << 32) - 1 - F.col("ms"))
    best = cut.groupBy("barcode", "i").agg(F.max(packed).alias("best"), F.sum("n").alias("total"))
    parent = ((1 << 32) - 1 - F.col("best").bitwiseAND(F.lit((1 << 32) - 1))).cast("int")
    best = best.where(F.shiftright("best", 32) >= threshold).select("barcode", "i", parent.alias("parent"), "total")
    return whole.unionByName(cut.join(best, ["barcode", "i"]))


def _roots(parents: DataFrame) -> DataFrame:
    """``(barcode, i, root)`` from ``(barcode, i, parent)``; parents come before their children.

    Each round doubles the steps that a pointer takes.
    """
    at = parents.select("barcode", "i", F.col("parent").alias("root"))
    while True:
        upper = at.select("barcode", F.col("i").alias("root"), F.col("root").alias("above"))
        moved = cut_lineage(at.join(upper, ["barcode", "root"], "left"))
        at = moved.select("barcode", "i", F.coalesce("above", "root").alias("root"))
        if moved.where("above IS NOT NULL").isEmpty():
            return at


def _merge_by_read(members: DataFrame) -> DataFrame:
    """``(barcode, raw, low)``: clusters that share a read are united under the least of them.

    Only reads that lie in several clusters are looked at; every round moves each cluster to the least that one of
    its reads, or its own place, knows.
    """
    on = members.select("barcode", "raw", "read").distinct()
    several = on.groupBy("barcode", "read").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low < high")
    on = cut_lineage(on.join(several.select("barcode", "read"), ["barcode", "read"]))
    label = on.select("barcode", "raw").distinct().withColumn("low", F.col("raw"))
    while True:
        by_read = on.join(label, ["barcode", "raw"]).groupBy("barcode", "read").agg(F.min("low").alias("low"))
        lower = on.join(by_read, ["barcode", "read"]).groupBy("barcode", "raw").agg(F.min("low").alias("to"))
        far = label.select("barcode", F.col("raw").alias("to"), F.col("low").alias("further"))
        moved = cut_lineage(
            label.join(lower, ["barcode", "raw"]).join(far, ["barcode", "to"], "left")
            .select("barcode", "raw", "low", F.coalesce("further", "to").alias("to"))
        )
        label = moved.select("barcode", "raw", F.col("to").alias("low"))
        if moved.where("to < low").isEmpty():
            return label


def _list_blocks(batches):
    """Rows ``(hash, barcode, read, depth, mine)`` come by hash and barcode; blocks of them hold all rows of a hash."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            rows = pa.Table.from_batches(held).combine_chunks()
            hashes = rows.column(0).to_numpy()
            done = int(np.searchsorted(hashes, hashes[-1]))
            held = rows.slice(done).to_batches()
            if done:
                yield as_batch([block_of(rows.slice(0, done))])
    if held:
        yield as_batch([block_of(pa.Table.from_batches(held))])


def _lists(good: DataFrame) -> DataFrame:
    """``(block)``: the rows of ``good(hash, barcode, read, depth, mine)`` by hash, ascending by barcode."""
    rows = good.repartition("hash").sortWithinPartitions("hash", "barcode")
    began = time.monotonic()
    made = cut_lineage(rows.select("hash", "barcode", "read", "depth", "mine").mapInArrow(_list_blocks, SCHEMA))
    give_up(good.sparkSession, began)
    return made


def _dealt_batches(batches, k: int, slices: int):
    """Rows ``(barcode, depth, hash, read, others)`` of the barcodes of slice ``k``, from blocks of :func:`_lists`."""
    for rows in tables_in(batches):
        rows = rows.combine_chunks()
        hashes, barcode = rows.column("hash").to_numpy(), rows.column("barcode").to_numpy()
        starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        ends = np.append(starts, len(hashes))
        others = _packed(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(barcode)))
        mixed = barcode.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        here = np.flatnonzero(rows.column("mine").to_numpy() & (mixed % np.uint64(slices) == k))
        lists = np.searchsorted(starts, here, "right") - 1
        size = np.cumsum(np.diff(np.frombuffer(others.buffers()[1], np.int32)[:len(starts) + 1])[lists].astype(np.int64) + 32)
        cuts = np.flatnonzero(np.diff(size // _BYTES_AT_ONCE)) + 1
        for at, of in zip(np.split(here, cuts), np.split(lists, cuts), strict=True):
            some = rows.select(["barcode", "depth", "hash", "read"]).take(pa.array(at)).combine_chunks()
            taken = others.take(pa.array(of))
            if len(at):
                yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in some.columns), taken], names=[*some.column_names, "others"])


def _lowest(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of ``n`` groups."""
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, group, value)
    return low


def _united(cluster: np.ndarray, read: np.ndarray, n: int) -> np.ndarray:
    """The least of the clusters that each of ``n`` is united with, through the reads they share."""
    label = np.arange(n)
    while True:
        by_read = _lowest(read, label[cluster], int(read.max(initial=-1)) + 1)
        # a cluster goes where the least cluster that one of its reads knows has gone
        moved = label[np.minimum(label, _lowest(cluster, by_read[read], n))]
        if (moved == label).all():
            return label
        label = moved


def _within(group: np.ndarray) -> np.ndarray:
    """Numbers from 0 within each of the groups, whose rows stand together."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])[:len(group)])
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))


def _labels_of(barcode: np.ndarray, read: pa.Array, others: pa.ListArray, threshold: int, start: int):
    """``(i, raw, sub, share)`` of the good hashes of whole barcodes, which stand together by depth and hash."""
    new = np.append(True, barcode[1:] != barcode[:-1])
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)[group]
    i = np.arange(len(group)) - begin
    looked = np.flatnonzero(i >= start)
    row, ms, n = _meetings_of(group[looked], barcode[looked], i[looked], others.take(pa.array(looked)))
    row = looked[row]
    # count and place in one number, the highest of which is the largest count at the earliest place
    packed = (n << 32) | ((1 << 32) - 1 - ms)
    at = np.flatnonzero(np.diff(row, prepend=-1))
    best, total = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    if len(at):
        best[row[at]] = np.maximum.reduceat(packed, at)
        total[row[at]] = np.add.reduceat(n, at)
    joined = np.flatnonzero((best >> 32 >= threshold) & (total > 0))
    # parents come before their children; each round doubles the steps
    root = np.arange(len(i))
    root[joined] = begin[joined] + (1 << 32) - 1 - (best[joined] & ((1 << 32) - 1))
    while (root[root] != root).any():
        root = root[root]
    share = np.zeros(len(i))
    first = (root[row] != row) & (begin[row] + ms == root[row])
    share[row[first]] = n[first] / total[row[first]]
    # clusters are numbered as they are founded: by the first hash that joins the founder
    founder, founded = np.unique(root[joined], return_index=True)
    founder = founder[np.argsort(founded)]
    raw, of = np.zeros(len(i), np.int64), np.full(len(i), -1)
    raw[founder] = _within(group[founder]) + 1
    of[founder] = np.arange(len(founder))
    raw, of = raw[root], of[root]
    known = np.flatnonzero((of >= 0) & read.is_valid().to_numpy(zero_copy_only=False))
    order, apart = _by_group(group[known], read.take(pa.array(known)).to_numpy())
    low = _united(of[known[order]], np.cumsum(apart) - 1, len(founder))
    # the clusters that are left are numbered by their least
    left = np.flatnonzero(low == np.arange(len(low)))
    number = np.zeros(len(low) + 1, np.int64)
    number[left] = _within(group[founder[left]]) + 1
    number[:-1] = number[low]
    return i, raw, number[of], share


def _label_batches(batches, threshold: int, start: int):
    """Rows ``(barcode, depth, hash, read, others)`` come by barcode, depth and hash; a barcode is held until its last row came."""
    held: list[pa.RecordBatch] = []
    pairs = 0

    def labelled(last: bool):
        nonlocal held, pairs
        rows = pa.Table.from_batches(held).combine_chunks()
        barcode = rows.column("barcode").to_numpy()
        done = len(barcode) if last else int(np.searchsorted(barcode, barcode[-1]))
        held = rows.slice(done).to_batches()
        pairs = sum(len(b.column(4).flatten()) for b in held)
        if not done:
            return None
        barcode, depth, hashes, read, others = (c.chunk(0) for c in rows.slice(0, done).columns)
        i, raw, sub, share = _labels_of(barcode.to_numpy(), read, others, threshold, start)
        numbers = [pa.array(x.astype(np.int32)) for x in (i, raw, sub)]
        names = ["barcode", "hash", "read", "depth", "i", "raw", "sub", "share"]
        return pa.RecordBatch.from_arrays([barcode, hashes, read, depth, *numbers, pa.array(share)], names=names)

    for batch in batches:
        if batch.num_rows:
            lists = _unpacked(batch.column(4))
            held.append(pa.RecordBatch.from_arrays([*batch.columns[:4], lists], names=batch.schema.names))
            pairs += len(lists.flatten())
        if pairs >= _PAIRS_AT_ONCE and (some := labelled(last=False)):
            yield some
    if held:
        yield labelled(last=True)


def _slices(pairs: int) -> int:
    return min(SLICES, max(1, -(-pairs // SLICE_PAIRS)))


def _whole_labels(good: DataFrame, pairs: int, threshold: int, start: int) -> DataFrame:
    """Labels of the barcodes whose rows of ``good(hash, barcode, read, depth, mine)`` are marked, of so many pairs."""
    lists = _lists(good)
    slices = _slices(pairs)
    made = []
    for k in range(slices):
        rows = lists.mapInArrow(lambda batches, k=k: _dealt_batches(batches, k, slices), _ROWS_SCHEMA)
        dealt = rows.repartition("barcode").sortWithinPartitions("barcode", "depth", "hash")
        began = time.monotonic()
        made.append(cut_lineage(dealt.mapInArrow(lambda batches: pack_batches(_label_batches(batches, threshold, start)), SCHEMA)))
        give_up(good.sparkSession, began)
    return unpacked(reduce(DataFrame.unionByName, made), _LABELS_SCHEMA)


def _cut_labels(good: DataFrame, mine: DataFrame, threshold: int, start: int) -> DataFrame:
    """Labels of barcodes of any size, whose rows of ``good`` are ``mine``. Null barcodes have no clusters."""
    mine = cut_lineage_packed(_numbered(mine))
    joined = cut_lineage_packed(_joined(good, mine.where("barcode IS NOT NULL"), start, threshold))
    # the place where a hash joins is one row of its tally
    roots = _roots(joined.where("ms = parent").select("barcode", "i", "parent"))
    # clusters are numbered as they are founded: by the first hash that joins the founder
    founders = grouped_rank(roots.groupBy("barcode", "root").agg(F.min("i").alias("founded")), ["barcode"], ["founded"], "raw")
    founders = founders.select("barcode", "root", F.col("raw").cast("int").alias("raw"))
    at_founder = joined.select("barcode", "i", F.col("ms").alias("root"), (F.col("n") / F.col("total")).alias("share"))
    inner = roots.join(at_founder, ["barcode", "i", "root"], "left").join(founders, ["barcode", "root"]).select(
        "barcode", "i", "raw", F.coalesce("share", F.lit(0.0)).alias("share")
    )
    first = founders.select("barcode", F.col("root").alias("i"), "raw", F.lit(0.0).alias("share"))
    members = cut_lineage_packed(mine.join(inner.unionByName(first), ["barcode", "i"], "left"))
    clustered = members.where("raw IS NOT NULL")
    united = _merge_by_read(clustered)
    # the clusters that are left are numbered by their least
    labels = clustered.select("barcode", "raw").distinct().join(united, ["barcode", "raw"], "left")
    labels = labels.select("barcode", "raw", F.coalesce("low", "raw").alias("low"))
    numbers = grouped_rank(labels.where("low = raw").select("barcode", "low"), ["barcode"], ["low"], "sub")
    labels = labels.join(numbers, ["barcode", "low"]).select("barcode", "raw", F.col("sub").cast("int").alias("sub"))
    return members.join(labels, ["barcode", "raw"], "left").select(
        "barcode", "hash", "read", "depth", "i",
        F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("sub", F.lit(0)).alias("sub"),
        F.coalesce("share", F.lit(0.0)).alias("share"),
    )


def cluster_hashes(
    inc: DataFrame,
    ranges: Sequence[tuple[int, int]],
    threshold: int = DEFAULT_THRESHOLD,
    start: int = 1,
    codes: tuple[int, int] | None = None,
) -> DataFrame:
    """Cluster every barcode, or those in the half-open range ``codes`` (0 as its end: no end).

    One row per good hash: ``(barcode, hash, read, depth, i, raw, sub, share)``, where ``raw`` and
    ``sub`` are its cluster before and after uniting clusters that share a read (0: none), and
    ``share`` is the part of the met barcodes that were first met at the founder of the cluster.
    A barcode has room for 2**31 good hashes.
    """
    good = cut_lineage_packed(_good(inc, ranges))
    wanted = F.lit(True)
    if codes is not None:
        low, high = codes
        wanted = F.col("barcode") >= low
        wanted = wanted & (F.col("barcode") < high) if high else wanted
    sizes = cut_lineage(good.where(wanted).groupBy("barcode").agg(F.sum("depth").alias("pairs")))
    large = (F.col("pairs") > PAIRS) | F.col("barcode").isNull()
    pairs, cut_pairs = sizes.agg(*[F.sum(F.when(which, F.col("pairs"))) for which in (~large, large)]).first()
    marked = good.withColumn("mine", wanted)
    if cut_pairs is None:
        return _whole_labels(marked.where("barcode IS NOT NULL"), pairs or 0, threshold, start)
    marked = cut_lineage_packed(
        marked.join(sizes.where(large).select("barcode", F.lit(True).alias("large")), "barcode", "left")
        .select("barcode", "hash", "read", "depth", "mine", F.coalesce("large", F.col("barcode").isNull()).alias("large"))
    )
    slices = _slices(cut_pairs)
    cut = [
        cut_lineage_packed(_cut_labels(marked, some.select("barcode", "hash", "read", "depth"), threshold, start))
        for some in (
            marked.where(F.expr("mine AND large") & (F.pmod(F.xxhash64("barcode"), F.lit(slices)) == k)) for k in range(slices)
        )
    ]
    marked = marked.where("barcode IS NOT NULL").select("barcode", "hash", "read", "depth", F.expr("mine AND NOT large").alias("mine"))
    return reduce(DataFrame.unionByName, cut, _whole_labels(marked, pairs or 0, threshold, start))


def code_clusters(labels: DataFrame) -> DataFrame:
    """``(barcode, n_good, n_sub, point_to_min)`` of each clustered barcode."""
    return labels.groupBy("barcode").agg(
        F.count("*").alias("n_good"),
        F.max("sub").alias("n_sub"),
        F.sum("share").alias("point_to_min"),
    )


def code_summary(codes: DataFrame, labels: DataFrame) -> DataFrame:
    """Reads, hashes, good hashes, clustered hashes, clustered reads and clusters per barcode."""
    in_cluster = F.col("sub") > 0
    clustered = labels.groupBy("barcode").agg(
        F.count("*").alias("n_good"),
        F.count_if(in_cluster).alias("n_clus_hash"),
        F.count_distinct(F.when(in_cluster, F.col("read"))).alias("n_clus_read"),
        F.max("sub").alias("n_sub"),
    )
    names = ["n_good", "n_clus_hash", "n_clus_read", "n_sub"]
    return codes.join(clustered, "barcode", "left").fillna(0, names)


def min_point_density(labels: DataFrame) -> DataFrame:
    """Share of good hashes that point to the founder of their cluster, over all barcodes."""
    return labels.agg(
        F.try_divide(F.sum("share"), F.count("*")).alias("min_point_density")
    )


def cluster_report(labels: DataFrame, crib: DataFrame, n_others: int = 10) -> DataFrame:
    """Per cluster: reads, hashes, truth classes, and the stretch of the chromosome of its first hash.

    Hashes on other chromosomes are counted in ``n_other``; the last ``n_others`` are listed.
    """
    typed = labels.where(F.col("sub") > 0).join(crib.select("hash", "type", "chr", "pos"), "hash")
    key = ["barcode", "sub"]
    placed = typed.where(F.col("type").isin("htA", "htB", "hom"))
    per_chr = placed.groupBy(*key, "chr").agg(
        F.min("hash").alias("first"), F.min("pos").alias("lo"), F.max("pos").alias("hi"),
        F.count("*").alias("n"),
    )
    span = F.struct("chr", "lo", "hi", "n")
    home = per_chr.groupBy(*key).agg(
        F.min_by(span, "first").alias("home"), F.sum("n").alias("n_placed")
    ).select(
        *key, "home.chr", "home.lo", (F.col("home.hi") - F.col("home.lo") + 1).alias("span"),
        (F.col("n_placed") - F.col("home.n")).alias("n_other"),
    )
    latest = Window.partitionBy(*key).orderBy(F.desc("hash"))
    others = (
        placed.join(home.select(*key, F.col("chr").alias("home_chr")), key)
        .where(F.col("chr") != F.col("home_chr"))
        .withColumn("_r", F.row_number().over(latest))
        .where(F.col("_r") <= n_others)
        .groupBy(*key)
        .agg(F.reverse(F.sort_array(F.collect_list("hash"))).alias("others"))
    )
    counts = typed.groupBy(*key).agg(
        F.count_distinct("read").alias("n_read"),
        F.count("*").alias("n_hash"),
        *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("hom", "htA", "htB", "mul", "err")],
    )
    return counts.join(home, key, "left").join(others, key, "left").fillna(0, ["n_other"])


def split_codes(
    inc: DataFrame, codes: DataFrame, labels: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Give every cluster a barcode of its own.

    Clustered rows move to new barcodes, numbered after the largest old one in barcode and cluster
    order; their reads are renumbered by first hash. The rest stay. Returns the new incidence rows and
    ``(barcode, n_read, n_hash, parent)``.
    """
    per_code = labels.groupBy("barcode").agg(F.max("sub").alias("n_sub"))
    subs = running_sum(
        codes.select("barcode").join(per_code, "barcode", "left").fillna(0, ["n_sub"]),
        "barcode", "n_sub", "before",
    )
    top = codes.agg(F.max("barcode").alias("top"))
    numbered = subs.where(F.col("n_sub") > 0).join(F.broadcast(top))
    # everything that follows is made of these rows
    clustered = labels.where("sub > 0").select("barcode", "hash", "sub")
    marked = cut_lineage_packed(inc.select("barcode", "hash", "read").join(clustered, ["barcode", "hash"], "left"))
    in_cluster = F.col("sub").isNotNull()
    moved = cut_lineage_packed(
        marked.where(in_cluster)
        .join(numbered.select("barcode", (F.col("top") + F.col("before")).alias("base")), "barcode")
        .select((F.col("base") + F.col("sub")).alias("barcode"), "hash", "read", F.col("barcode").alias("parent"))
    )
    first = moved.groupBy("barcode", "read").agg(F.min("hash").alias("first"))
    reads = grouped_rank(first, ["barcode"], ["first", "read"], "new_read")
    reads = reads.select("barcode", "read", (F.col("new_read") - 1).alias("new_read"))
    moved = moved.join(reads, ["barcode", "read"]).select(
        "barcode", "hash", F.col("new_read").cast("bigint").alias("read"), "parent"
    )
    stay = marked.where(~in_cluster).select("barcode", "hash", F.col("read").cast("bigint").alias("read"))
    rows = stay.unionByName(moved.drop("parent"))
    kept = codes.select("barcode", F.col("n_read").cast("bigint").alias("n_read")).join(
        stay.groupBy("barcode").agg(F.count("*").alias("n_hash")), "barcode", "left"
    ).fillna(0, ["n_hash"]).withColumn("parent", F.lit(None).cast("bigint"))
    made = moved.groupBy("barcode").agg(
        F.count_distinct("read").alias("n_read"), F.count("*").alias("n_hash"),
        F.max("parent").cast("bigint").alias("parent"),
    )
    return rows, kept.unionByName(made)


def explore_code(
    inc: DataFrame,
    ranges: Sequence[tuple[int, int]],
    crib: DataFrame,
    barcode: int,
    threshold: int = DEFAULT_THRESHOLD,
) -> dict[str, DataFrame]:
    """All reports on one barcode: its clusters (from hash number 0), and whom it shares hashes with."""
    labels = cluster_hashes(inc, ranges, threshold, start=0, codes=(barcode, barcode + 1))
    mine = labels.select("hash", "i")
    shared = (
        inc.join(mine, "hash").where(F.col("barcode") != barcode)
        .groupBy("barcode")
        .agg(F.count("*").alias("shared"), F.min(F.struct("i", "hash")).alias("first"))
    )
    het = (
        inc.join(shared.select("barcode"), "barcode", "left_semi")
        .join(crib.where(F.col("type").isin("htA", "htB")).select("hash", "type"), "hash")
        .groupBy("barcode")
        .agg(
            F.count_if(F.col("type") == "htA").alias("n_htA"),
            F.count_if(F.col("type") == "htB").alias("n_htB"),
        )
    )
    share = shared.where(F.col("shared") >= threshold).join(het, "barcode", "left").select(
        "barcode", "shared", F.coalesce("n_htA", F.lit(0)).alias("n_htA"),
        F.coalesce("n_htB", F.lit(0)).alias("n_htB"),
        F.col("first.i").alias("min_share"), F.col("first.hash").alias("min_hash"),
    )
    everyone = inc.select("barcode").distinct().join(shared, "barcode", "left")
    counts = hist.histogram(everyone.select(F.coalesce("shared", F.lit(0)).alias("shared")), "shared")
    return {
        "labels": labels,
        "clusters": cluster_report(labels, crib),
        "share_histogram": counts,
        "share": share,
    }
