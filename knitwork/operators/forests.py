"""Connected components without a round for each step of distance: forests of partitions, contracted from level to level.

A level deals links to partitions by range. Each partition keeps a forest over its
links, in arrays: every node below the largest node that it is connected with
there. A node gets at most one such root from each forest. It is put below the
largest one, and its roots are linked with each other. Nodes below nodes below
others are brought to the top by doubling. What remains are links between nodes
that are below none, at most half of all nodes, and they are the next level's
links. Once there are few, one task takes them all; their number is the bound of
its memory. At the end labels go back through the levels.

The label is the largest node. So rounds grow with the logarithm of the number
of nodes, however long the paths are.

Defined cases: loops, repeated links and links in both directions count once;
links with a null end are none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitwork.plans.supersteps import Result
from knitwork.sources.hypergraph import Hypergraph
from knitwork.sources.shared import written

#: Links that one task takes all of, and links that a task holds before it makes them a forest.
TOGETHER, HELD = 1_000_000, 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some links, and the largest node that each is connected with."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, parent = place[: len(a)], place[len(a) :], np.arange(len(nodes))
    while left.size:
        low, high = np.minimum(parent[left], parent[right]), np.maximum(parent[left], parent[right])
        apart = low != high
        left, right, low, high = left[apart], right[apart], low[apart], high[apart]
        np.maximum.at(parent, low, high)  # both are roots, so every root goes below a larger one, if any
        while (up := parent[parent]) is not None and (up != parent).any():
            parent = up
    return nodes, nodes[parent]


def _forests(links: DataFrame, held: int) -> DataFrame:
    """(node, root) of the forests of all partitions; a partition has several if its nodes are more than a task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def told(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["node", "root"])

        def grown() -> tuple[np.ndarray, np.ndarray]:
            node, root = forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            below = node != root
            return node[below], root[below]

        for batch in batches:
            parts.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            rows += batch.num_rows
            if rows >= held:
                parts = [grown()]
                rows = len(parts[0][0])
                if rows > held // 2:
                    yield told(*parts[0])
                    parts, rows = [], 0
        if rows:
            yield told(*grown())

    return links.mapInArrow(run, "node long, root long")


def _doubled(below: DataFrame) -> tuple[DataFrame, int]:
    """Every node below the top of what it was below, and how many passes that took."""
    passes = 0
    while True:
        up = below.select(F.col("node").alias("top"), F.col("top").alias("above"))
        higher = below.join(up, "top", "left").select("node", F.coalesce("above", "top").alias("top"), F.col("above").isNotNull().alias("moved"))
        higher = written(higher, "tops")
        passes += 1
        below = higher.select("node", "top")
        if not higher.filter("moved").limit(1).count():
            return below, passes


def components(links: DataFrame, together: int = TOGETHER, held: int = HELD) -> tuple[DataFrame, int]:
    """(node, label) of every node of links (a, b), and the number of passes over links or nodes."""
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = written(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b"), "links")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    levels: list[DataFrame] = []
    rounds = 0
    while n := links.count():
        rounds += 1
        if n <= together:
            levels.append(written(_forests(links.repartition(1), max(held, n + 1)), "forests").withColumnRenamed("root", "top"))
            break
        found = _forests(links.repartitionByRange(parts, "a", "b"), held)
        # as many roots as there are forests at most
        tops = written(found.groupBy("node").agg(F.max("root").alias("top"), F.collect_set("root").alias("roots")), "roots")
        below, passes = _doubled(tops.select("node", "top"))
        rounds += passes
        levels.append(below)
        pairs = written(tops.select(F.col("top").alias("b"), F.explode("roots").alias("a")).filter("a <> b").distinct(), "pairs")
        for end in ("a", "b"):
            pairs = pairs.join(below.withColumnsRenamed({"node": end, "top": "up"}), end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
        links = written(pairs.filter("a <> b").distinct(), "links")
    for below in reversed(levels):
        higher = nodes.select(F.col("node").alias("top"), "label")
        nodes = written(below.join(higher, "top", "left").select("node", F.coalesce("label", "top").alias("label")).unionByName(nodes), "labels")
    tops = nodes.select(F.col("label").alias("node"), "label").distinct()
    return nodes.unionByName(tops), rounds


def connected(graph: Hypergraph, together: int = TOGETHER, held: int = HELD) -> Result:
    """Components of a hypergraph, whatever the direction of its incidences; the label is the largest hyperedge id, null without any.

    On undirected hypergraphs the same as the message passing program with hyperedges as uniques.
    """
    vertex = lambda c: -1 - F.col(c)  # noqa: E731  below all hyperedges
    links = graph.v2e.select(F.col("e").alias("a"), vertex("v").alias("b"))
    if not graph.mirrored:  # else both relations hold the same links
        links = links.unionByName(graph.e2v.select(F.col("e").alias("a"), vertex("v").alias("b")))
    labels, rounds = components(links, together, held)
    of = lambda elements, node, alone: (
        elements.select("id").join(labels.select(node.alias("id"), "label"), "id", "left").select("id", F.coalesce("label", alone).alias("value"), F.lit(False).alias("active"))
    )
    vertices = of(graph.vertices, vertex("node"), F.lit(None).cast("long"))
    return Result(vertices, of(graph.hyperedges, F.col("node"), F.col("id")), rounds, True, None)
