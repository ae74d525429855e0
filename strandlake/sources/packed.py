"""Files of fixed-size packed read pairs as a splittable Spark data source.

``spark.read.format("packed_pairs").load(path)`` gives ``(ordinal, record)``: each task reads its own
byte range. Bulk storage of pairs is Parquet; this format is for exchange.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from ..functions.packing import RECORD_BYTES, unpack_pair

SPLIT_RECORDS = 1 << 20
BATCH_RECORDS = 1 << 14


def _file_system(path: str):
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    count: int
    ordinal: int

    def __post_init__(self):
        super().__init__(self.ordinal)


class _Reader(DataSourceReader):
    def __init__(self, path: str, split_records: int):
        self.path, self.split_records = path, split_records

    def partitions(self):
        system, root = _file_system(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.Directory:
            files = [
                f for f in system.get_file_info(fs.FileSelector(root))
                if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))
            ]
        else:
            files = [info]
        ranges, ordinal = [], 0
        for file in sorted(files, key=lambda f: f.path):
            if file.size % RECORD_BYTES:
                raise ValueError(f"{file.path} does not hold whole records")
            records = file.size // RECORD_BYTES
            for first in range(0, records, self.split_records):
                count = min(self.split_records, records - first)
                ranges.append(_Range(file.path, first, count, ordinal))
                ordinal += count
        return ranges

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.path)
        with system.open_input_file(partition.path) as file:
            file.seek(partition.first * RECORD_BYTES)
            for done in range(0, partition.count, BATCH_RECORDS):
                n = min(BATCH_RECORDS, partition.count - done)
                records = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(RECORD_BYTES), n, [None, file.read_buffer(n * RECORD_BYTES)]
                )
                start = partition.ordinal + done
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(start, start + n), pa.int64()), records.cast(pa.binary())],
                    ["ordinal", "record"],
                )


@dataclass
class _Written(WriterCommitMessage):
    attempt: str
    final: str


class _Writer(DataSourceArrowWriter):
    """One file per task. An attempt writes a hidden file of its own; files get their names when the whole
    write commits, and a later write to the same folder adds to it."""

    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = _file_system(self.path)
        system.create_dir(root, recursive=True)
        task = TaskContext.get()
        final = f"part-{self.run}-{task.partitionId():05d}.pairs"
        attempt = f"{root}/.{final}.{task.taskAttemptId()}"
        with system.open_output_stream(attempt) as out:
            for batch in iterator:
                # the cast demands that every record has its size, and then the batch is one buffer
                records = batch.column(batch.schema.get_field_index("record")).cast(pa.binary(RECORD_BYTES))
                start = records.offset * RECORD_BYTES
                out.write(records.buffers()[1][start:start + len(records) * RECORD_BYTES])
        return _Written(attempt, f"{root}/{final}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _file_system(self.path)
        for message in messages:
            if message is not None:
                system.move(message.attempt, message.final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _file_system(self.path)
        for message in messages:
            if message is not None:
                system.delete_file(message.attempt)


class PackedPairs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_pairs"

    def schema(self) -> str:
        return "ordinal bigint, record binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("splitrecords", SPLIT_RECORDS)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("packed pairs can only be appended")
        return _Writer(self.options["path"])


def read_packed_pairs(
    spark: SparkSession, path: str, limit: int = 0, lengths: tuple[int, int] | None = None
) -> DataFrame:
    """``(barcode, read, seq1, qual1, seq2, qual2)``; ``limit`` keeps the first records of the file.

    Records do not tell how long a read was and fill its place with A; ``lengths`` of both mates cut that off.
    The read number is the record number, unique over the file; rows of a barcode need not be adjacent.
    """
    spark.dataSource.register(PackedPairs)
    rows = spark.read.format("packed_pairs").load(path)
    if limit:
        rows = rows.where(F.col("ordinal") < limit)
    unpacked = rows.select(F.col("ordinal").alias("read"), unpack_pair(F.col("record")).alias("p"))
    pairs = unpacked.select("p.barcode", "read", "p.seq1", "p.qual1", "p.seq2", "p.qual2")
    if lengths:
        cut = {f"{kind}{mate}": F.substring(f"{kind}{mate}", 1, lengths[mate - 1]) for kind in ("seq", "qual") for mate in (1, 2)}
        pairs = pairs.withColumns(cut)
    return pairs


def write_packed_pairs(pairs: DataFrame, path: str, record: str = "record") -> None:
    """Write 120-byte records, range-partitioned and sorted by their first four bytes as stored."""
    pairs.sparkSession.dataSource.register(PackedPairs)
    key = F.hex(F.substring(F.col(record), 1, 4))
    ordered = pairs.withColumn("_key", key).repartitionByRange("_key").sortWithinPartitions("_key")
    ordered.select(F.lit(0).cast("bigint").alias("ordinal"), F.col(record).alias("record")).write.format(
        "packed_pairs"
    ).mode("append").save(path)
