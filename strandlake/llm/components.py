"""Connected components of links between numbers, by alternating large and small stars.

Every round replaces the links by links to the lowest neighbour; it ends when the links stay as they are.
The links are checkpointed each round. Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: A hub's links are dealt over so many parts.
HUB_SALTS = 8


def _with_lowest(links: DataFrame, also_self: bool) -> DataFrame:
    """Links ``(u, v)`` with ``m``, the lowest of all ``v`` of ``u`` (and of ``u``)."""
    lowest = F.least("u", F.min("v")) if also_self else F.min("v")
    lows = links.groupBy("u").agg(lowest.alias("m"))
    lows = lows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(HUB_SALTS - 1))))
    dealt = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(HUB_SALTS)).cast("int"))
    return dealt.join(lows, ["u", "salt"]).drop("salt")


def _large_star(links: DataFrame) -> DataFrame:
    """``links`` go from the higher to the lower end; neighbours above a node move to its lowest."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    stars = _with_lowest(both, also_self=True)
    return stars.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """The lower neighbours of a node, and the node, move to its lowest neighbour."""
    stars = _with_lowest(links.distinct(), also_self=False)
    down = stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = stars.where("v = m").select("u", F.col("m").alias("v"))
    return down.unionByName(own).distinct()


def _state(links: DataFrame) -> tuple:
    check = F.sum((F.xxhash64("u", "v") % 1_000_000_007).cast("bigint"))
    return tuple(links.agg(F.count("*"), check).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every number in ``links(u, v)``; the root is the lowest of its component."""
    straight = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    links = cut_lineage(links.where("u <> v").select(*straight).distinct())
    before, now = None, _state(links)
    while before != now:
        links = cut_lineage(_small_star(_large_star(links)))
        before, now = now, _state(links)
    members = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
