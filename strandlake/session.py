"""Session settings and the helper that cuts lineage."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .functions import blocks

#: Share of the seconds of a job that are waited before its files are given up, and the most seconds.
WAIT = 0.1
LONGEST_WAIT = 1.5


def build_session(master: str | None = None, app: str = "strandlake", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder that ``spark.checkpoint.dir`` names.

    Only a session without that setting (a local test) gets a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="strandlake-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def cut_lineage_packed(df: DataFrame) -> DataFrame:
    """The same with rows in compressed blocks, for tables of the size of the input.

    What the job shuffled is given up before the next begins.
    """
    began = time.monotonic()
    packed = cut_lineage(df.mapInArrow(blocks.pack_batches, blocks.SCHEMA))
    give_up(df.sparkSession, began)
    return unpacked(packed, df.schema)


def unpacked(packed: DataFrame, schema: StructType | str) -> DataFrame:
    """The rows in ``packed(block)``."""
    return packed.mapInArrow(blocks.unpack_batches, schema)


def give_up(spark: SparkSession, began: float) -> None:
    """Delete shuffle files and checkpoints that no table refers to any more, after a job that ``began`` at that time.

    Spark's cleaner does so when the driver collects its garbage, which a large heap may put off until the disks are full.
    Python hands tables back once a second, for which a long job waits; the files of a short one may go with the next.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(min(LONGEST_WAIT, WAIT * (time.monotonic() - began)))
    spark.sparkContext._jvm.System.gc()
