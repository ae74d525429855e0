"""Rows as compressed blocks: the columns of many rows, written as Parquet into one value."""

from __future__ import annotations

import io

import pyarrow as pa
import pyarrow.parquet as pq

#: Rows of a block, if its bytes leave room.
ROWS = 200_000
#: Bytes of a block before it is compressed.
BYTES = 64 << 20

SCHEMA = "block binary"


def block_of(rows: pa.Table) -> bytes:
    """Whole numbers are written as bit-packed steps, which leave little of sorted columns."""
    steps = {f.name: "DELTA_BINARY_PACKED" for f in rows.schema if pa.types.is_integer(f.type)}
    others = [f.name for f in rows.schema if f.name not in steps]
    out = io.BytesIO()
    pq.write_table(
        rows, out, compression="zstd", use_dictionary=others or False, column_encoding=steps or None,
        write_statistics=False, store_schema=True,
    )
    return out.getvalue()


def rows_of(block: bytes | memoryview) -> pa.Table:
    return pq.ParquetFile(pa.BufferReader(block)).read(use_threads=False)


def as_batch(blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["block"])


def pack_batches(batches):
    """Arrow batches of any columns to batches of one block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS or sum(b.nbytes for b in held) >= BYTES:
            yield as_batch([block_of(pa.Table.from_batches(held))])
            held = []
    if held:
        yield as_batch([block_of(pa.Table.from_batches(held))])


def tables_in(batches):
    """The rows of each block."""
    for batch in batches:
        for block in batch.column(0):
            yield rows_of(block.as_buffer())


def unpack_batches(batches):
    for rows in tables_in(batches):
        yield from rows.to_batches(max_chunksize=20_000)
