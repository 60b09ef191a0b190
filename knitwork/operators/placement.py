"""Where a partitioned run would keep its elements: placement, copies, masters, new ids and replication.

Spark does not need these to run programs; they answer what a vertex-cut layout
over ``parts`` partitions would look like. Uniques live in one partition,
replicas in every partition that holds one of their out-neighbours; a replica
without any gets one by hash. The smallest partition of a replica is its master.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knitwork.sources.adjacency_text import running_total


def by_modulo(uniques: DataFrame, parts: int) -> DataFrame:
    """(id, part)."""
    return uniques.select("id", F.pmod("id", F.lit(parts)).cast("long").alias("part"))


def by_table(uniques: DataFrame, placement: DataFrame) -> DataFrame:
    """(id, part) from a given table; an id without a place raises when it is read."""
    given = placement.select("id", F.col("part").cast("long").alias("part"))
    missing = F.raise_error(F.concat(F.lit("no partition for "), F.col("id").cast("string"))).cast("long")
    return uniques.select("id").join(given, "id", "left").select("id", F.coalesce("part", missing).alias("part"))


def local(incidence: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, part, to): every out-neighbour ``to`` of a replica in the partition that it lives in."""
    return incidence.join(placed.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "part", F.col("dst").alias("to"))


def copies(replicas: DataFrame, incidence: DataFrame, placed: DataFrame, parts: int) -> DataFrame:
    """(id, part, n_local): local out-neighbours of each copy. ``incidence`` is (src, dst) from replicas to uniques."""
    return copies_of(replicas, incidence, local(incidence, placed), parts)


def copies_of(replicas: DataFrame, incidence: DataFrame, there: DataFrame, parts: int) -> DataFrame:
    """``copies`` from ``there``, the rows of ``local``."""
    counted = there.groupBy("id", "part").agg(F.count("*").alias("n_local"))
    alone = replicas.select("id").join(incidence.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    return counted.unionByName(alone.select("id", F.pmod("id", F.lit(parts)).cast("long").alias("part"), F.lit(0).cast("long").alias("n_local")))


def masters(held: DataFrame) -> DataFrame:
    """(id, master)."""
    return held.groupBy("id").agg(F.min("part").alias("master"))


def servants(held: DataFrame) -> DataFrame:
    """(id, part) of the copies that are not masters."""
    return held.join(masters(held), "id").filter(F.col("part") != F.col("master")).select("id", "part")


def new_ids(held: DataFrame, parts: int) -> DataFrame:
    """(id, new_id): numbers of the same remainder as the master, in order of ids.

    Ranks come from counts of id ranges, not from one sorted partition per master.
    """
    counted = masters(held).withColumn("bucket", F.floor(F.col("id") / 65_536))
    sums = counted.groupBy("master", "bucket").agg(F.count("*").alias("n"))
    base = sums.select("master", "bucket", F.coalesce(F.sum("n").over(W.partitionBy("master").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(W.partitionBy("master", "bucket").orderBy("id")) - 1
    ranked = counted.withColumn("inside", inside).join(base, ["master", "bucket"])
    return ranked.select("id", ((F.col("base") + F.col("inside")) * parts + F.col("master")).alias("new_id"))


def replication(held: DataFrame) -> DataFrame:
    """One row: replicas, copies and copies per replica."""
    return held.groupBy("id").agg(F.count("*").alias("n")).agg(F.count("*").alias("replicas"), F.sum("n").alias("copies"), (F.sum("n") / F.count("*")).alias("factor"))


__all__ = ["by_modulo", "by_table", "copies", "copies_of", "local", "masters", "new_ids", "replication", "running_total", "servants"]
