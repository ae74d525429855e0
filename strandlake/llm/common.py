"""What several operators share: tables, bounded Arrow batches, texts as bytes."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An Arrow batch that goes to Python holds at most so many rows and bytes, but always one row.
BATCH_ROWS = 4096
BATCH_BYTES = 32 << 20
#: Copies of the small side of a join whose keys may be hot; the large side is dealt over them.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with batches that are bounded in rows and in bytes."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def text_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """The texts of a column as UTF-8, one at a time."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py()


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it is."""
    by_letter = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    # the quick built-in does the same where each character is one byte
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(by_letter)


def salt(*columns: str) -> Column:
    """A number below ``SALTS`` by which rows of one key are dealt out."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS))


def all_salts() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
