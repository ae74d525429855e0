"""Shards of near-equal size by longest-processing-time scheduling.

Rows with equal texts form a group that must stay together. Groups go, largest first, to the shard with
the least load, kept in a heap. The heap runs in the driver over a number of items that does not depend on
the input: groups above ``1 / MAX_GROUPS`` of all bytes, of which there are fewer than ``MAX_GROUPS``, are
items of their own; all smaller groups are pooled by hash into ``POOLS`` items. With ``n`` shards the loads
differ by at most the smallest item placed last, about ``1 / POOLS`` of all bytes.

The size of a row is the UTF-8 length of its text (null: 0) plus ``ROW_BYTES``. Null and empty texts are
one group. A row keeps its place in the shard (``slot``) by order of id within 1,024 parts of the shard;
rows that repeat id and text take neighbouring slots. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ROW_BYTES = 16
MAX_GROUPS = 40_000
POOLS = 1 << 16
PARTS = 1024


def schedule(items: list[tuple[int, object]], n_shards: int) -> dict:
    """Shard of each ``(size, name)``: largest first, each to the least loaded shard."""
    loads = [(0, shard) for shard in range(n_shards)]
    placed = {}
    for size, name in sorted(items, key=lambda item: (-item[0], item[1])):
        load, shard = loads[0]
        placed[name] = shard
        heapq.heapreplace(loads, (load + size, shard))
    return placed


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, size, text_crc32, group)``; the group is a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        # different texts with one hash would merely stay together
        F.xxhash64(text).alias("group"),
    )


def assign(rows: DataFrame, n_shards: int) -> DataFrame:
    """Add ``shard`` to rows with ``(size, group)``."""
    spark = rows.sparkSession
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = F.col("bytes") * MAX_GROUPS > total
    pool = F.pmod(F.col("group"), F.lit(POOLS))
    items = groups.groupBy(
        F.when(large, F.col("group")).alias("alone"), F.when(~large, pool).alias("pool")
    ).agg(F.sum("bytes").alias("bytes"))
    # fewer than MAX_GROUPS + POOLS rows
    placed = schedule(
        [(r.bytes, (r.pool is None, r.alone if r.pool is None else r.pool)) for r in items.collect()],
        n_shards,
    )
    alone = [(name, shard) for (own, name), shard in placed.items() if own]
    pools = [(name, shard) for (own, name), shard in placed.items() if not own]
    alone = spark.createDataFrame(alone, "group bigint, own_shard int")
    pools = spark.createDataFrame(pools, "pool bigint, pool_shard int")
    return (
        rows.withColumn("pool", pool)
        .join(F.broadcast(alone), "group", "left")
        .join(F.broadcast(pools), "pool", "left")
        .withColumn("shard", F.coalesce("own_shard", "pool_shard"))
        .drop("pool", "own_shard", "pool_shard")
    )


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... within each shard, without sorting a shard in one task."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(PARTS)))
    within = Window.partitionBy("shard", "part").orderBy(*order)
    local = rows.withColumn("local", F.row_number().over(within) - 1)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))  # at most PARTS rows a shard
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (
        local.join(F.broadcast(starts), ["shard", "part"])
        .withColumn("slot", F.col("start") + F.col("local"))
        .drop("part", "local", "start")
    )


def shard_documents(
    docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, size, text_crc32, shard, slot)`` for every row."""
    rows = cut_lineage(sized(docs, id_col, text_col))
    placed = cut_lineage(assign(rows, n_shards).drop("group"))
    return number(placed, [id_col, "text_crc32", "size"])
