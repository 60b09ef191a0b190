"""The line-oriented adjacency format: header, four counts, then offsets and neighbours of both sides.

Layout: line 0 names the kind; lines 1-4 hold the numbers of vertices, vertex
incidences, hyperedges and hyperedge incidences; then the start offset of each
vertex, its neighbours, in the weighted kind a weight per neighbour, and the
same for hyperedges. A weight belongs to the element that the incidence points
at; of several the one on the last line counts.

The text is scanned twice, once to count the lines of each split and once to number
them; the numbered lines are written as a table in order of lines, and each section
is read from it by its range of lines, of which other row groups are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knitwork.sources.hypergraph import MOST_ID, Hypergraph
from knitwork.sources.shared import written

# The two kinds of file.
PLAIN, WEIGHTED = "AdjacencyHypergraph", "WeightedAdjacencyHypergraph"
#: Neighbours of one element that are enumerated at a time.
_STRIDE = 4096


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) in file order. Only one row per input split is sorted in one place."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("before", before).drop("n")
    return rows.join(F.broadcast(starts), ["file", "block"]).select((F.col("at") - F.col("first") + F.col("before")).alias("line"), F.col("value").alias("text"))


def _number(strict: bool, begin: int, n: int) -> Column:
    """The number in each of n lines. The bounds are part of the expression, since filters may run after it."""
    whole = F.when(F.col("text").rlike(r"^\+?[0-9]+$"), F.col("text").try_cast("long"))
    known = F.when(whole <= MOST_ID + 1, whole)
    fault = F.raise_error(F.concat(F.lit("not an unsigned 32-bit number in line "), F.col("line").cast("string"))).cast("long")
    return F.when((F.col("line") >= begin) & (F.col("line") < begin + n), F.coalesce(known, fault) if strict else known)


def offsets(lines: DataFrame, begin: int, n: int, total: int, strict: bool = True) -> DataFrame:
    """(id, first, end) of the neighbour list of each of n elements. The first offset counts as 0."""
    own = lines.filter((F.col("line") >= begin) & (F.col("line") < begin + n)).select((F.col("line") - begin).alias("id"), _number(strict, begin, n).alias("first"))
    own = own.withColumn("first", F.when(F.col("id") == 0, 0).otherwise(F.col("first")))
    ends = own.select((F.col("id") - 1).alias("id"), F.col("first").alias("end"))
    return own.join(ends, "id", "left").withColumn("end", F.coalesce("end", F.lit(total)))


def _side(lines: DataFrame, begin: int, n: int, m: int, weighted: bool, own: str, other: str, strict: bool) -> tuple[DataFrame, DataFrame | None]:
    spans = offsets(lines, begin, n, m, strict).filter("first < end")
    strides = spans.select("id", "end", F.explode(F.sequence("first", F.col("end") - 1, F.lit(_STRIDE))).alias("s"))
    owners = strides.select("id", F.explode(F.sequence("s", F.least(F.col("s") + _STRIDE, "end") - 1)).alias("at"))
    found = lines.filter((F.col("line") >= begin + n) & (F.col("line") < begin + n + m)).select((F.col("line") - (begin + n)).alias("at"), _number(strict, begin + n, m).alias("other"))
    inc = owners.join(found, "at").select(F.col("id").alias(own), F.col("other").alias(other))
    if not weighted:
        return inc, None
    notes = lines.filter((F.col("line") >= begin + n + m) & (F.col("line") < begin + n + 2 * m)).select((F.col("line") - (begin + n + m)).alias("at"), "text")
    weights = found.join(notes, "at").groupBy(F.col("other").alias("id")).agg(F.max_by("text", "at").alias("weight"))
    return inc, weights


def read_adjacency(spark: SparkSession, path: str, strict: bool = True) -> Hypergraph:
    """Read the format; ``strict`` raises on anything but unsigned 32-bit numbers, else such entries become null."""
    lines = written(numbered_lines(spark, path), "lines")
    head = {r["line"]: r["text"] for r in lines.filter("line < 5").collect()}
    kind = (head.get(0) or "").strip()
    if kind not in (PLAIN, WEIGHTED):
        raise ValueError(f"unknown kind of hypergraph file: {kind!r}")
    nv, mv, ne, me = (int(head[k]) for k in range(1, 5))
    weighted = kind == WEIGHTED
    v2e, edge_weights = _side(lines, 5, nv, mv, weighted, "v", "e", strict)
    e2v, vertex_weights = _side(lines, 5 + nv + mv * (1 + weighted), ne, me, weighted, "e", "v", strict)

    def elements(n: int, weights: DataFrame | None) -> DataFrame:
        ids = spark.range(n)
        return ids.withColumn("weight", F.lit(None).cast("string")) if weights is None else ids.join(weights, "id", "left")

    return Hypergraph(elements(nv, vertex_weights), elements(ne, edge_weights), v2e, e2v)


def running_total(table: DataFrame, key: str, value: str, bucket: int = 65_536) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over all smaller keys, by sums of buckets and then within each bucket."""
    held = table.withColumn("bucket_", F.floor(F.col(key) / bucket))
    sums = held.groupBy("bucket_").agg(F.sum(value).alias("sum_"))
    base = sums.select("bucket_", F.coalesce(F.sum("sum_").over(W.orderBy("bucket_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("bucket_").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("inside_", inside).join(base, "bucket_").withColumn("before", F.col("base_") + F.col("inside_")).drop("bucket_", "inside_", "base_")


def csr_offsets(elements: DataFrame, inc: DataFrame, side: str) -> DataFrame:
    """(id, first) of the neighbour lists in order of ids."""
    counts = inc.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("n"))
    degrees = elements.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    return running_total(degrees, "id", "n").select("id", F.col("before").alias("first"))


def _places(inc: DataFrame, own: str, other: str, bucket: int = 65_536) -> DataFrame:
    """Adds ``place``: the rank of an incidence among those of its element, by ranks within ranges of the other ids, so that hubs are split."""
    dealt = inc.withColumn("range_", F.floor(F.col(other) / bucket))
    sums = dealt.groupBy(own, "range_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(W.partitionBy(own).orderBy("range_").rowsBetween(W.unboundedPreceding, -1))
    base = sums.select(own, "range_", F.coalesce(before, F.lit(0)).alias("base_"))
    inside = F.row_number().over(W.partitionBy(own, "range_").orderBy(other)) - 1
    return dealt.withColumn("inside_", inside).join(base, [own, "range_"]).withColumn("place", F.col("base_") + F.col("inside_")).drop("range_", "inside_", "base_")


def write_adjacency(graph: Hypergraph, path: str, weighted: bool = False, parts: int | None = None) -> None:
    """Write the format; ids must be dense from 0. Lines are range-partitioned by number, so parts are read back in order.

    The weight of a line is that of the element pointed at, or, where the incidence has a column ``weight``, its own.
    """
    spark = graph.v2e.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [f.count() for f in (graph.vertices, graph.v2e, graph.hyperedges, graph.e2v)]
    nv, mv, ne, _ = sizes
    head = spark.createDataFrame([(k, str(t)) for k, t in enumerate([WEIGHTED if weighted else PLAIN, *sizes])], "line long, text string")
    out = head
    for begin, elements, inc, own, other, targets, n, m in (
        (5, graph.vertices, graph.v2e, "v", "e", graph.hyperedges, nv, mv),
        (5 + nv + mv * (1 + weighted), graph.hyperedges, graph.e2v, "e", "v", graph.vertices, ne, sizes[3]),
    ):
        first = csr_offsets(elements, inc, own)
        out = out.unionByName(first.select((F.col("id") + begin).alias("line"), F.col("first").cast("string").alias("text")))
        if weighted and "weight" not in inc.columns:
            inc = inc.join(targets.select(F.col("id").alias(other), "weight"), other)
        placed = _places(inc, own, other).join(first.withColumnRenamed("id", own), own).withColumn("at", F.col("first") + F.col("place"))
        out = out.unionByName(placed.select((F.col("at") + begin + n).alias("line"), F.col(other).cast("string").alias("text")))
        if weighted:
            out = out.unionByName(placed.select((F.col("at") + begin + n + m).alias("line"), F.coalesce("weight", F.lit("1")).alias("text")))
    out.repartitionByRange(parts, "line").sortWithinPartitions("line").select("text").write.mode("overwrite").text(path)
