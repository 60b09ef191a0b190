"""The hypergraph data model: elements and two directed incidence relations as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids above this are reserved.
MOST_ID = 4294967294
#: Counters by hash in ``frequent``, and how many of them at most are looked for by number.
COUNTERS, FEW_SLOTS = 65_536, 256


@dataclass(frozen=True)
class Hypergraph:
    """``vertices`` and ``hyperedges`` (id, weight); ``v2e`` (v, e) and ``e2v`` (e, v), both multisets.

    ``buckets`` is the number of buckets by sender that the incidences are stored in, 0 if they are not. ``mirrored`` says that both
    relations hold the same incidences, so that an element hears along as many as it sends along. ``ends`` names the sides ("v", "e") whose
    elements are just the ends of these incidences, each once and without a weight, so that elements need not be put together from their table.
    """

    vertices: DataFrame
    hyperedges: DataFrame
    v2e: DataFrame
    e2v: DataFrame
    buckets: int = 0
    mirrored: bool = False
    ends: tuple[str, ...] = ()

    def dual(self) -> Hypergraph:
        """Vertices and hyperedges change places."""
        return Hypergraph(
            self.hyperedges, self.vertices,
            self.e2v.select(F.col("e").alias("v"), F.col("v").alias("e")), self.v2e.select(F.col("v").alias("e"), F.col("e").alias("v")), self.buckets, self.mirrored,
            tuple({"v": "e", "e": "v"}[side] for side in self.ends),
        )

    def vertex_degree(self) -> DataFrame:
        return _degree(self.vertices, self.v2e, "v")

    def hyperedge_degree(self) -> DataFrame:
        return _degree(self.hyperedges, self.e2v, "e")

    def adjacency(self) -> DataFrame:
        """Sorted out-neighbours of every vertex with any, duplicates kept (for display and export)."""
        return self.v2e.groupBy(F.col("v").alias("id")).agg(F.sort_array(F.collect_list("e")).alias("neighbours"))

    def checked(self) -> Hypergraph:
        """Raises if an incidence names an unknown element or an id is out of range."""
        for name, inc in (("v2e", self.v2e), ("e2v", self.e2v)):
            for side, elements in (("v", self.vertices), ("e", self.hyperedges)):
                if inc.join(elements, inc[side] == elements["id"], "left_anti").take(1):
                    raise ValueError(f"{name} names an unknown {side}")
        for elements in (self.vertices, self.hyperedges):
            if elements.filter((F.col("id") < 0) | (F.col("id") > MOST_ID) | F.col("id").isNull()).take(1):
                raise ValueError("an id is out of range")
        return self

    def write(self, path: str, mode: str = "errorifexists") -> None:
        for name in ("vertices", "hyperedges", "v2e", "e2v"):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    def save_bucketed(self, name: str, buckets: int | None = None, mode: str = "errorifexists") -> Hypergraph:
        """Tables ``name_vertices`` and so on, with incidences in sorted buckets by sender. Programs that run over what is returned, or what
        ``bucketed`` reads, use the buckets as they are: incidences are not exchanged again."""
        n = buckets or int(self.v2e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        for part, rows, sender in (("v2e", self.v2e, "v"), ("e2v", self.e2v, "e")):
            rows.repartition(n, sender).write.mode(mode).bucketBy(n, sender).sortBy(sender).saveAsTable(f"{name}_{part}")
        for part in ("vertices", "hyperedges"):
            getattr(self, part).write.mode(mode).saveAsTable(f"{name}_{part}")
        return bucketed(self.v2e.sparkSession, name, n)


def bucketed(spark: SparkSession, name: str, buckets: int) -> Hypergraph:
    """What ``save_bucketed`` stored, in so many buckets."""
    return Hypergraph(*(spark.table(f"{name}_{part}") for part in ("vertices", "hyperedges", "v2e", "e2v")), buckets)


def _degree(elements: DataFrame, inc: DataFrame, side: str) -> DataFrame:
    counts = inc.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("degree"))
    return elements.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def frequent(rows: DataFrame, keys: list[str], more_than: int) -> DataFrame:
    """(keys, n) of all keys with more than so many rows. Rows are first counted by hash; keys are counted only where such a counter is that
    high, so usually none are."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(COUNTERS))
    full = [r["slot"] for r in rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).filter(F.col("n") > more_than).select("slot").collect()]
    if not full:
        return rows.select(*keys, F.lit(0).cast("long").alias("n")).limit(0)
    candidates = rows.filter(slot.isin(full)) if len(full) <= FEW_SLOTS else rows
    return candidates.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > more_than)


def read(spark: SparkSession, path: str) -> Hypergraph:
    return Hypergraph(*(spark.read.parquet(f"{path}/{name}") for name in ("vertices", "hyperedges", "v2e", "e2v")))


def _elements(ids: DataFrame, column: str) -> DataFrame:
    return ids.select(F.col(column).cast("long").alias("id")).filter("id IS NOT NULL").distinct().withColumn("weight", F.lit(None).cast("string"))


def from_table(table: DataFrame, edge: str, vertex: str, vertices: DataFrame | None = None, hyperedges: DataFrame | None = None) -> Hypergraph:
    """An undirected hypergraph of two columns; element tables (id, weight) may add isolated elements."""
    inc = table.select(F.col(vertex).cast("long").alias("v"), F.col(edge).cast("long").alias("e")).filter("v IS NOT NULL AND e IS NOT NULL")
    ends = tuple(side for side, given in (("v", vertices), ("e", hyperedges)) if given is None)
    return Hypergraph(
        _elements(inc, "v") if vertices is None else vertices, _elements(inc, "e") if hyperedges is None else hyperedges, inc, inc.select("e", "v"), mirrored=True, ends=ends
    )
