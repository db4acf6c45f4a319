"""Connected components of a table of links, by alternating stars; every round ends in a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilframe.llm.common import discard, written


def _state(edges: DataFrame) -> tuple:
    # Shifted, so the sum of hashes cannot overflow.
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 32))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has a link; the root is the smallest node of its component.

    Links are undirected, may repeat and may lead to the node itself; null ends are ignored. A node with many links is
    reduced to one minimum by an aggregate before the join, so no task gathers its neighbours.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    current = written(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
                      .where(u.isNotNull() & v.isNotNull() & (u != v)).distinct(), "links")
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(nearest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = (met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        following = written(small, "links")
        found = _state(following)
        discard(current)
        current = following
        if found == state:
            break
        state = found
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
