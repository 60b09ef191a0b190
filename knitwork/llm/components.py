"""Connected components of a link table, by alternating large and small stars.

Every round rewires each node to the smallest id around it; the number of rounds
grows with the logarithm of the component size, also for chains. Each round is a
pre-aggregated minimum and one join, written to the shared folder. The minima
are written before the join, so that Spark knows their size and can split the
links of a node with very many.

Defined cases: loops, repeated links and links given in both directions count
once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitwork.llm.common import stored


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Connect all larger neighbours of a node to the smallest one around it."""
    around = _both(links)
    least = stored(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")
    return around.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Connect all smaller neighbours of a node, and the node, to the smallest of them. Links point from larger to smaller."""
    least = stored(links.groupBy("a").agg(F.min("b").alias("least")), "least")
    moved = links.join(least, "a")
    rewired = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
    return rewired.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).collect()[0])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): smallest reachable id for every node with a link. Ids are the columns a and b."""
    now = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(now, "links")
    before = _state(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        now = stored(_small_star(stored(_large_star(now), "links")), "links")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("node"), "component").unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
