"""Incremental counting of sampled k-mers with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sketch import sketch
from ..operators.sketchset import count_sequences
from ..spec import HashSpec, SKETCH_SPEC


def running_counts(stream: DataFrame, seq: str = "seq", spec: HashSpec = SKETCH_SPEC) -> DataFrame:
    """Streaming ``(hash, depth)``; run it in update or complete mode. Counts live in the state store."""
    return sketch(stream, [], seq, spec).groupBy("hash").agg(F.count("*").alias("depth"))


def start_accumulating(
    stream: DataFrame, path: str, checkpoint: str, seq: str = "seq", spec: HashSpec = SKETCH_SPEC
) -> StreamingQuery:
    """Write one small sketch set per micro-batch below ``path``; a replayed batch replaces its own.

    No state is kept: :func:`load_accumulated` adds the sets up when they are read.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        counted = count_sequences(batch, seq, spec)
        counted.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def load_accumulated(spark: SparkSession, path: str) -> DataFrame:
    """The sketch set of everything accumulated so far."""
    return spark.read.parquet(path).groupBy("hash").agg(
        F.sum(F.col("depth").cast("bigint")).alias("depth"),
        F.least(F.sum("copy"), F.lit(3)).cast("tinyint").alias("copy"),
    )
