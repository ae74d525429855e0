"""Document fingerprints by order MinHash, which see the order of a text as well as its content.

A text's runs of ``CHARS`` code points are numbered by occurrence (the second "the same " differs from the first), so
that repeats count. Each numbered run has a hash, whose first bits deal it to one of ``PARTS`` parts. Of a part the
``TUPLE`` runs with the lowest hashes are selected, put back in the order in which they stand in the text, and the
tuple is hashed. The fingerprint is the list of these hashes, 0 where a part has no run. Texts that are a few edits apart
have the same tuples in most parts; texts with the same runs in another order do not.

The likeness of two fingerprints is the share of equal hashes among the parts that either text has a run in; 1 if neither
has any. Texts shorter than ``CHARS`` are one run.

``edited_documents`` fingerprints each text and an edited one: its last half is replaced by the start of the next
document in descending order of ids. Documents are dealt by ranges of ids and sorted, which shuffles every text once; a task
then sees each document with its next. The first and last of every partition are set aside as rows of their own, and meet
by the number of the partition: two rows for each.

A null text is empty. A null id comes after all others, documents that share an id go by a hash of the text; so rows that
repeat both stand next to each other. One document is its own next. Empty tables give no rows. A very long text takes
memory in proportion to its length. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_batches

CHARS = 5
PARTS = 64
TUPLE = 2

_PART_BITS = PARTS.bit_length() - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
#: Runs are told apart by the bits of their hash before these.
_PLACE_BITS = 24
_PLACES = np.uint64((1 << _PLACE_BITS) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


def _run_hashes(codes: np.ndarray, chars: int) -> np.ndarray:
    """A hash of every run of ``chars`` code points."""
    hashes = np.zeros(max(1, len(codes) - chars + 1), np.uint64)
    if len(codes) < chars:
        for code in codes:
            hashes = hashes * _BASE + code
    else:
        for i in range(chars):
            hashes = hashes * _BASE + codes[i:i + len(hashes)]
    return _mixed(hashes)


def _order(values: np.ndarray) -> np.ndarray:
    """Places of the values by their first ``64 - _PLACE_BITS`` bits, equal ones in the order of the text."""
    if len(values) >> _PLACE_BITS:
        return np.argsort(values >> np.uint64(_PLACE_BITS), kind="stable")
    # value and place in one number, which sorts quicker
    packed = np.sort((values & ~_PLACES) | np.arange(len(values), dtype=np.uint64))
    return (packed & _PLACES).astype(np.int64)


def _lowest(items: np.ndarray) -> np.ndarray:
    """Numbers of the ``TUPLE`` lowest items of each part, -1 where it has fewer."""
    order = _order(items)
    starts = np.searchsorted(items[order] & ~_PLACES, np.arange(PARTS, dtype=np.uint64) << np.uint64(64 - _PART_BITS))
    at = starts[:, None] + np.arange(TUPLE)
    return np.where(at < np.append(starts[1:], len(order))[:, None], order[np.minimum(at, len(order) - 1)], -1)


def fingerprint(codes: np.ndarray, chars: int = CHARS) -> np.ndarray:
    """``PARTS`` numbers of 32 bits of the code points of a text."""
    if not len(codes):
        return np.zeros(PARTS, np.uint32)
    hashes = _run_hashes(codes, chars)
    n = len(hashes)
    place = _order(hashes)
    run = hashes[place] >> np.uint64(_PLACE_BITS)
    first = np.append(True, run[1:] != run[:-1])
    since = np.arange(n)
    occurrence = since - np.maximum.accumulate(np.where(first, since, 0))
    items = _mixed(run + occurrence.astype(np.uint64) * _BASE)
    # most parts have their lowest below this; if not, all items are looked at
    few = np.flatnonzero(items << np.uint64(_PART_BITS) < np.uint64(min(2**64 - 1, 2**64 * 16 * PARTS // n)))
    chosen = _lowest(items[few]) if len(few) else np.full((PARTS, TUPLE), -1)
    if (chosen < 0).any() and len(few) < n:
        few = np.arange(n)
        chosen = _lowest(items)
    there = chosen >= 0
    # in the order of the text; what a part lacks comes first
    at = np.sort(np.where(there, place[few[np.maximum(chosen, 0)]], -1), axis=1)
    total = np.zeros(PARTS, np.uint64)
    for i in range(TUPLE):
        total = _mixed(total * _BASE + np.where(at[:, i] >= 0, hashes[np.maximum(at[:, i], 0)], np.uint64(0)) + np.uint64(1))
    return np.where(there.any(axis=1), (total >> _SHIFT) | np.uint64(1), np.uint64(0)).astype(np.uint32)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    used = (one != 0) | (other != 0)
    n = int(used.sum())
    return float(((one == other) & used).sum() / n) if n else 1.0


def codes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def edited(text: str | None, following: str | None) -> str:
    """``text`` whose last half is replaced by as much of the start of ``following``."""
    text, following = text or "", following or ""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _row(key, text, mark: np.ndarray, following, next_mark: np.ndarray) -> tuple:
    changed = edited(text, following)
    changed_mark = fingerprint(codes_of(changed))
    digest = hashlib.sha256(changed.encode()).hexdigest()
    return (key, len(text or ""), digest, mark.tobytes(), changed_mark.tobytes(), likeness(mark, changed_mark), likeness(mark, next_mark))


_RESULT = "n_chars bigint, edited_sha256 string, mark binary, edited_mark binary, near_edited double, near_next double"
_TYPES = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())


def _with_next(batches):
    """Rows ``(part, id, text)`` come in order: results of all but the last, and the first and the last with their texts."""

    def out(results, ends):
        nothing = (None,) * 6
        rows = [(*r, None, None, None) for r in results] + [(key, *nothing, part, end, text) for end, part, key, text in ends]
        columns = list(zip(*rows, strict=True))
        kinds = [key_type, *_TYPES, pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["id", "n_chars", "edited_sha256", "mark", "edited_mark", "near_edited", "near_next", "part", "end", "text"],
        )

    before, ends = None, []
    for batch in batches:
        key_type = batch.column(1).type
        results = []
        for part, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            mark = fingerprint(codes_of(text))
            if before is None:
                ends.append(("first", part, key, text))
            else:
                results.append(_row(*before[1:], text, mark))
            before = part, key, text, mark
        if results:
            yield out(results, [])
    if before is not None:
        yield out([], [*ends, ("last", *before[:3])])


def _borders(ends: DataFrame) -> DataFrame:
    """Results of the last document of each partition, whose next is the first of the next partition with rows."""
    first = ends.where("end = 'first'").select("part", F.col("text").alias("following"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    # the numbers of the partitions
    numbers = first.select("part", F.lead("part").over(order).alias("then"), F.min("part").over(Window.partitionBy(F.lit(0))).alias("least"))
    numbers = numbers.select("part", F.coalesce("then", "least").alias("then"))
    last = ends.where("end = 'last'").select("part", "id", "text").join(numbers, "part")
    pairs = last.join(first.withColumnRenamed("part", "then"), "then").select("id", "text", "following")

    def finish(batches):
        for batch in batches:
            rows = [
                _row(key, text, fingerprint(codes_of(text)), following, fingerprint(codes_of(following)))
                for key, text, following in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            ]
            kinds = [batch.column(0).type, *_TYPES]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["id", "n_chars", "edited_sha256", "mark", "edited_mark", "near_edited", "near_next"],
            )

    return map_batches(pairs, finish, f"id {ends.schema['id'].dataType.simpleString()}, {_RESULT}")


def edited_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of every row."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    order = [F.desc_nulls_last("id"), F.xxhash64("text"), F.col("text")]
    rows = rows.repartitionByRange(parts, order[0], order[1]).sortWithinPartitions(*order)
    rows = rows.select(F.spark_partition_id().alias("part"), "id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    found = cut_lineage(map_batches(rows, _with_next, f"id {kind}, {_RESULT}, part int, end string, text string"))
    whole = found.where("end IS NULL").drop("part", "end", "text")
    results = whole.unionByName(_borders(found.where("end IS NOT NULL")))
    return results.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", F.lower(F.hex("mark")).alias("fingerprint"),
        F.lower(F.hex("edited_mark")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
