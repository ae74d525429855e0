"""Arrow functions that turn a sequence into its sampled k-mers.

One call handles a whole Arrow batch: the bases of all rows form one byte vector, k-mer codes come
from doubling (2, 4, 8, ... bases at a time), and only sampled hits are mapped back to rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf

from ..spec import HashSpec

HIT_TYPE = "array<struct<ord:int,pos:int,hash:bigint,is_fwd:boolean>>"
_BLOCK = 1 << 17

_CODES = np.zeros(256, dtype=np.uint8)
for _i, _base in enumerate("ACGT"):
    _CODES[ord(_base)] = _CODES[ord(_base.lower())] = _i


def _row_bases(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Base codes of the batch and the row offsets into them."""
    if isinstance(seqs, pa.ChunkedArray):
        seqs = seqs.combine_chunks()
    if seqs.null_count:
        seqs = seqs.fill_null("")
    width = np.int64 if pa.types.is_large_string(seqs.type) else np.int32
    _, offset_buffer, data = seqs.buffers()
    if len(seqs) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(seqs) + 1, np.int64)
    offsets = np.frombuffer(offset_buffer, width)[seqs.offset:seqs.offset + len(seqs) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return _CODES[raw], offsets - offsets[0]


def _kmer_codes(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward codes and reverse-strand codes of every window of ``k`` bases."""
    n = len(bases) - k + 1
    run_f = bases.astype(np.uint64)
    run_r = np.uint64(3) - run_f
    size, done = 1, 0
    forward = reverse = None
    while True:
        if k & size:
            part_f, part_r = run_f[done:done + n], run_r[done:done + n]
            if forward is None:
                forward, reverse = part_f, part_r
            else:
                forward = (forward << np.uint64(2 * size)) | part_f
                reverse = reverse | (part_r << np.uint64(2 * done))
            done += size
        if done == k:
            return forward, reverse
        head = len(run_f) - size
        bits = np.uint64(2 * size)
        run_f = (run_f[:head] << bits) | run_f[size:]
        run_r = run_r[:head] | (run_r[size:] << bits)
        size *= 2


def strand_hashes(bases: np.ndarray, spec: HashSpec) -> tuple[np.ndarray, np.ndarray]:
    """Canonical hash and forward flag of every k-mer of ``bases``."""
    forward, reverse = _kmer_codes(bases, spec.k)
    factor, shift = np.uint64(spec.factor), np.uint64(spec.shift)
    hash_f = (forward * factor) >> shift
    hash_r = (reverse * factor) >> shift
    return np.minimum(hash_f, hash_r), hash_f < hash_r


def _as_lists(rows, n_rows, pos, hashes, is_fwd) -> pa.Array:
    offsets = np.zeros(n_rows + 1, np.int32)
    np.cumsum(np.bincount(rows, minlength=n_rows), out=offsets[1:])
    order = np.arange(len(rows), dtype=np.int32) - offsets[rows]
    hits = pa.StructArray.from_arrays(
        [
            pa.array(order, pa.int32()),
            pa.array(pos.astype(np.int32)),
            pa.array(hashes.astype(np.int64)),
            pa.array(is_fwd),
        ],
        ["ord", "pos", "hash", "is_fwd"],
    )
    return pa.ListArray.from_arrays(pa.array(offsets), hits)


def sampled_hits(seqs: pa.Array, spec: HashSpec) -> pa.Array:
    """For each row the k-mers whose canonical hash is a multiple of ``w``, in position order."""
    bases, offsets = _row_bases(seqs)
    n_rows = len(offsets) - 1
    found = [], [], []
    for start in range(0, max(len(bases) - spec.k + 1, 0), _BLOCK):
        hashes, is_fwd = strand_hashes(bases[start:start + _BLOCK + spec.k - 1], spec)
        kept = np.flatnonzero(hashes % np.uint64(spec.w) == 0)
        for column, values in zip(found, (kept + start, hashes[kept], is_fwd[kept])):
            column.append(values)
    if not found[0]:
        empty = np.zeros(0, np.int64)
        return _as_lists(empty, n_rows, empty, empty, np.zeros(0, bool))
    at, hashes, is_fwd = (np.concatenate(column) for column in found)
    rows = np.searchsorted(offsets, at, side="right") - 1
    inside = at + spec.k <= offsets[rows + 1]
    at, hashes, is_fwd, rows = at[inside], hashes[inside], is_fwd[inside], rows[inside]
    return _as_lists(rows, n_rows, at - offsets[rows], hashes, is_fwd)


def _window_winners(hashes: np.ndarray, sizes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each hash the index in its row of the winner of the window that starts there, and the rank of each hash."""
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    index = np.arange(len(hashes)) - (np.cumsum(sizes) - sizes)[row_of]
    # rows are set apart, so that no window takes a hash of the next row
    apart = np.arange(len(hashes)) + row_of * w
    order = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    key = np.full(len(hashes) + len(sizes) * w, np.iinfo(np.int64).max)
    key[apart] = order * w + index % w
    size = 1
    while size < w:
        step = min(size, w - size)
        key[:-step] = np.minimum(key[:-step], key[step:])
        size += step
    return index + (key[apart] % w - index) % w, order


def jump_minimizer_positions(hashes: np.ndarray, sizes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and indices that jumping minimizers visit, for rows of ``sizes`` hashes laid end to end.

    A row visits the least hash of its first ``w`` k-mers, then the least of the ``w`` k-mers after each
    visited one, until a window touches the end. A last window shorter than ``w`` counts only where it
    beats the previous hash. Among equal hashes the least index modulo ``w`` wins.

    The winner of the window at every index is found at once, by windows of doubling length; then all rows
    walk from window to window together.
    """
    first = np.cumsum(sizes) - sizes
    winner, order = _window_winners(hashes, sizes, w)
    start = np.zeros(len(sizes), np.int64)
    rows = np.flatnonzero(sizes > 0)
    last = np.full(len(sizes), np.iinfo(np.int64).max)
    found_rows, found = [], []
    while len(rows):
        at = winner[first[rows] + start[rows]]
        value = order[first[rows] + at]
        beaten = (start[rows] + w <= sizes[rows]) | (value < last[rows])
        rows, at, value = rows[beaten], at[beaten], value[beaten]
        found_rows.append(rows)
        found.append(at)
        last[rows] = value
        more = start[rows] + w < sizes[rows]
        start[rows] = at + 1
        rows = rows[more]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found_rows, found = np.concatenate(found_rows), np.concatenate(found)
    by_row = np.argsort(found_rows, kind="stable")
    return found_rows[by_row], found[by_row]


def _minimizers_of_rows(bases: np.ndarray, offsets: np.ndarray, spec: HashSpec):
    """``(row, pos, hash, is_fwd)`` of whole rows, all at once."""
    sizes = np.maximum(np.diff(offsets) - spec.k + 1, 0)
    if not sizes.sum():
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), np.zeros(0, bool)
    hashes, is_fwd = strand_hashes(bases, spec)
    first = np.cumsum(sizes) - sizes
    inside = np.repeat(offsets[:-1] - first, sizes) + np.arange(sizes.sum())
    hashes, is_fwd = hashes[inside], is_fwd[inside]
    rows, at = jump_minimizer_positions(hashes, sizes, spec.w)
    where = first[rows] + at
    return rows, at, hashes[where], is_fwd[where]


def _minimizers_of_pieces(bases: np.ndarray, spec: HashSpec):
    """``(pos, hash, is_fwd)`` of each piece of one row: the walk goes on where it left the piece before."""
    n, w = len(bases) - spec.k + 1, spec.w
    start, last = 0, None
    while start < n:
        # pieces start at a multiple of w, so that places modulo w are those of the whole row
        low = start - start % w
        high = min(n, low + _BLOCK + 2 * w)
        hashes, is_fwd = strand_hashes(bases[low:high + spec.k - 1], spec)
        winner = _window_winners(hashes, np.array([len(hashes)]), w)[0].tolist()
        values = hashes.tolist()
        found = []
        while start < n and (start + w <= high or high == n):
            at = winner[start - low]
            if start + w > n and last is not None and values[at] >= last:
                start = n
                break
            found.append(at)
            last = values[at]
            start = low + at + 1 if start + w < n else n
        at = np.array(found, np.int64)
        yield at + low, hashes[at], is_fwd[at]


def minimizer_hits(seqs: pa.Array, spec: HashSpec) -> pa.Array:
    """For each row the k-mers that the jumping minimizer visits.

    Rows are taken together up to ``_BLOCK`` bases, longer ones in pieces of that size.
    """
    bases, offsets = _row_bases(seqs)
    n_rows = len(offsets) - 1
    found = [], [], [], []
    begin = 0
    while begin < n_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + _BLOCK, side="right")) - 1)
        block = bases[offsets[begin]:offsets[end]]
        if len(block) > _BLOCK:
            parts = ((np.zeros(len(at), np.int64), at, *rest) for at, *rest in _minimizers_of_pieces(block, spec))
        else:
            parts = [_minimizers_of_rows(block, offsets[begin:end + 1] - offsets[begin], spec)]
        for rows, *rest in parts:
            for column, values in zip(found, (rows + begin, *rest)):
                column.append(values)
        begin = end
    if not found[0]:
        empty = np.zeros(0, np.int64)
        return _as_lists(empty, n_rows, empty, empty, np.zeros(0, bool))
    rows, at, hashes, is_fwd = (np.concatenate(column) for column in found)
    return _as_lists(rows, n_rows, at, hashes, is_fwd)


def sketch_udf(spec: HashSpec):
    """Column function: sequence to the array of its sampled hits."""

    @arrow_udf(HIT_TYPE)
    def sketch_hits(seq: pa.Array) -> pa.Array:
        return sampled_hits(seq, spec)

    return sketch_hits


def minimizer_udf(spec: HashSpec):
    """Column function: sequence to the array of its jumping minimizers."""

    @arrow_udf(HIT_TYPE)
    def jump_minimizers(seq: pa.Array) -> pa.Array:
        return minimizer_hits(seq, spec)

    return jump_minimizers
