"""Connected components by alternating large-star and small-star steps.

Each step is a partially aggregated minimum per node and a join back, so a hub with a third of all
links is pre-aggregated before its shuffle and its join partition can be split by AQE. Every round
is cut with a checkpoint, so that a lost executor never replays earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``(node, component)`` of every node in ``links``; component is its smallest node.

    Null ends and self links are ignored, repeated links count once, an empty table gives an empty
    one. ``a`` and ``b`` must be longs.
    """
    e = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    e = cut(e.distinct())
    before = None
    while (now := _print(e)) != before:
        before = now
        e = cut(_small_star(_large_star(e)))
    roots = e.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def _print(e: DataFrame) -> tuple:
    """Count and order-free hash of the links, to see that a round has changed nothing."""
    row = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.hash("hi", "lo").cast("long"))).first()
    return tuple(row)


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    return up.join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = e.join(least, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
