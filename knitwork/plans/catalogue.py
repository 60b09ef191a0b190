"""Registered queries of the hypergraph engine, and the same in SQL.

Hypergraphs of the test tables: OP joins orders (hyperedges) and parts
(vertices) through all line items; NC joins nations (hyperedges) and customers.
All queries read their tables whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knitwork.functions.programs import ALPHA, PAGE_RANK, components_program, connected_components, label_program, label_propagation, page_rank, run_algorithm, shortest_path, shortest_path_program
from knitwork.operators import forests, layout, placement
from knitwork.plans.supersteps import EDGE, VERTEX, HyperProgram, Incidence, Side, even, half_step, initial_state, run
from knitwork.sources import adjacency_text, placement_files
from knitwork.sources.hypergraph import Hypergraph, from_table
from knitwork.sources.shared import scratch, written

PARTS, BULK_QUANTITY = 4, 46
#: Links that one task takes all of in components by forests, so few that these tables go through levels too; width of a bucket of path lengths.
FOREST_LINKS, BUCKET = 20_000, 4


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_part(spark: SparkSession, sf_dir: str) -> Hypergraph:
    return from_table(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


def order_part_isolated(spark: SparkSession, sf_dir: str) -> Hypergraph:
    """OP with the orders that have no line item as isolated hyperedges."""
    edges = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("weight"))
    return from_table(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey", hyperedges=edges)


def _weights(items: DataFrame) -> DataFrame:
    """A hyperedge is as long as the number of its line items that are not bulk, plus one."""
    return items.groupBy(F.col("l_orderkey").alias("id")).agg((F.count_if(F.col("l_quantity") < BULK_QUANTITY) + 1).cast("string").alias("weight"))


def order_part_weighted(spark: SparkSession, sf_dir: str) -> Hypergraph:
    """OP with a length for every order."""
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return from_table(items, "l_orderkey", "l_partkey", hyperedges=_weights(items))


def nation_customer(spark: SparkSession, sf_dir: str) -> Hypergraph:
    return from_table(_table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey")


# Incidence of each hypergraph in SQL, and its elements.
_OP = "SELECT l_partkey AS v, l_orderkey AS e FROM lineitem"
_NC = "SELECT c_custkey AS v, c_nationkey AS e FROM customer"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("id", F.round("value", digits).alias("value"))


def _values(df: DataFrame) -> DataFrame:
    return df.select("id", "value")


def _rank_sql(k: int, side: str = "v", inc: str = _OP, dual: bool = False) -> str:
    """k supersteps, vertices damped and first to send (or, for the dual, the same with the sides exchanged)."""
    ctes = [f"inc AS ({inc.replace('AS v', 'AS tmp').replace('AS e', 'AS v').replace('AS tmp', 'AS e') if dual else inc})", "vd AS (SELECT v, count(*) AS d FROM inc GROUP BY v)", "ed AS (SELECT e, count(*) AS d FROM inc GROUP BY e)", "x0 AS (SELECT v, 1.0::DOUBLE AS x FROM vd)"]
    for s in range(1, k + 1):
        ctes.append(f"y{s} AS (SELECT inc.e, sum(({ALPHA} + (1 - {ALPHA}) * x) / d) AS y FROM x{s - 1} JOIN vd USING (v) JOIN inc USING (v) GROUP BY inc.e)")
        ctes.append(f"x{s} AS (SELECT inc.v, sum(y / d) AS x FROM y{s} JOIN ed USING (e) JOIN inc USING (e) GROUP BY inc.v)")
    last = f"SELECT v AS id, round(x, 6) AS value FROM x{k}" if side == "v" else f"SELECT e AS id, round(y, 6) AS value FROM y{k}"
    return "WITH " + ", ".join(ctes) + " " + last


def _component_ctes(inc: str) -> str:
    """cc(id, lab): largest hyperedge id reached; hyperedges have even and vertices odd node numbers."""
    return f"""WITH RECURSIVE inc AS ({inc}), adj AS (SELECT DISTINCT 2 * e AS a, 2 * v + 1 AS b FROM inc UNION ALL SELECT DISTINCT 2 * v + 1, 2 * e FROM inc),
cc(id, lab) USING KEY (id) AS (
  SELECT DISTINCT a, CASE WHEN a % 2 = 0 THEN a // 2 ELSE -1 END FROM adj
  UNION SELECT adj.b, max(cc.lab) FROM cc JOIN adj ON cc.id = adj.a JOIN recurring.cc AS r ON r.id = adj.b WHERE cc.lab > r.lab GROUP BY adj.b
)"""


def _path_ctes(source: str, inc: str = _OP, unit: bool = False, swap: bool = False) -> str:
    """sp(id, d): least cost of each vertex; the source is the smallest vertex unless given."""
    length = "SELECT e, 1 AS len FROM inc GROUP BY e" if unit else f"SELECT l_orderkey AS e, 1 + count(*) FILTER (l_quantity < {BULK_QUANTITY}) AS len FROM lineitem GROUP BY l_orderkey"
    inc = inc.replace("AS v", "AS tmp").replace("AS e", "AS v").replace("AS tmp", "AS e") if swap else inc
    return f"""WITH RECURSIVE inc AS ({inc}), len AS ({length}),
hop AS (SELECT DISTINCT x.v AS a, y.v AS b, x.e FROM inc x JOIN inc y USING (e) WHERE x.v <> y.v), step AS (SELECT a, b, min(len) AS len FROM hop JOIN len USING (e) GROUP BY a, b),
sp(id, d) USING KEY (id) AS (
  SELECT {source}, 0::BIGINT
  UNION SELECT step.b, min(sp.d + step.len) FROM sp JOIN step ON step.a = sp.id LEFT JOIN recurring.sp AS r ON r.id = step.b WHERE r.d IS NULL OR sp.d + step.len < r.d GROUP BY step.b
)"""


def _label_sql(k: int) -> str:
    ctes = [f"inc AS ({_OP})", "l0 AS (SELECT DISTINCT v, v AS lab FROM inc)"]
    best = "SELECT {d}, lab FROM (SELECT {d}, lab, row_number() OVER (PARTITION BY {d} ORDER BY count(*) DESC, lab) AS r FROM {s} JOIN inc USING ({k}) GROUP BY {d}, lab) WHERE r = 1"
    for s in range(1, k + 1):
        ctes.append(f"m{s} AS ({best.format(d='e', s=f'l{s - 1}', k='v')})")
        ctes.append(f"l{s} AS ({best.format(d='v', s=f'm{s}', k='e')})")
    return "WITH " + ", ".join(ctes)


def _first_half(spark: SparkSession, sf_dir: str, program: HyperProgram) -> DataFrame:
    """Hyperedges after one half-step from the vertices of OP. Where no hyperedge is hot, messages are dealt into a fixed number of partitions,
    so that no task reduces those of a whole part of the table."""
    g = order_part(spark, sf_dir)
    inc = g.v2e.select(F.col("v").alias("src"), F.col("e").alias("dst"))
    back = g.e2v.select(F.col("e").alias("src"), F.col("v").alias("dst"))
    senders, receivers = initial_state(g.vertices, inc, program.vertex), initial_state(g.hyperedges, back, program.edge)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, total, most = receivers.agg(F.count("*"), F.coalesce(F.sum("degree"), F.lit(0)), F.coalesce(F.max("degree"), F.lit(0))).head()
    return half_step(senders, Incidence(inc), receivers, program.vertex, program.edge, program, parts=parts if even(n, total, most, parts) else None)[1]


def _relay(initial: str) -> Side:
    return Side(
        initial=lambda: F.col(initial), message=lambda _: F.col("value"), apply=lambda: F.least("value", "inbox"), activate=lambda: F.col("inbox") < F.col("value")
    )


#: A program of a user: least vertex id within reach, where hyperedges start without a value of their own.
_FAR = 1 << 62
LEAST_LABEL = HyperProgram(
    vertex=_relay("id"),
    edge=Side(initial=lambda: F.lit(_FAR), message=lambda _: F.col("value"), apply=lambda: F.least("value", "inbox"), activate=lambda: F.col("inbox") < F.col("value"), starts_active=lambda: F.lit(False)),
    reduce=F.min,
)


def _placed(spark: SparkSession, sf_dir: str) -> tuple[Hypergraph, DataFrame, DataFrame]:
    g = order_part(spark, sf_dir)
    inc = g.v2e.select(F.col("v").alias("src"), F.col("e").alias("dst"))
    where = placement.by_modulo(g.hyperedges, PARTS)
    return g, where, placement.copies(g.vertices, inc, where, PARTS)


def _by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A placement given by files: orders by the first digit of their priority."""
    given = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("long").alias("part"))
    folder = scratch(spark, "placement")
    placement_files.write_placement(given, folder)
    return placement.by_table(order_part(spark, sf_dir).hyperedges, placement_files.read_placement(spark, folder))


def _nations(spark: SparkSession, sf_dir: str) -> Hypergraph:
    """NC with all nations, each as heavy as its number."""
    g = nation_customer(spark, sf_dir)
    nation = _table(spark, sf_dir, "nation")
    return Hypergraph(g.vertices, nation.select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") + 3).cast("string").alias("weight")), g.v2e, g.e2v)


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NC written as weighted text and read back: both incidences and the weights of nations."""
    path = scratch(spark, "text")
    adjacency_text.write_adjacency(_nations(spark, sf_dir), path, weighted=True)
    back = adjacency_text.read_adjacency(spark, path)
    row = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).cast("long").alias("b"))
    return row(back.v2e, "v2e", "v", "e").unionByName(row(back.e2v, "e2v", "e", "v")).unionByName(row(back.hyperedges, "weight", "id", "weight"))


def _last_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NC written with a weight of its own on every incidence, and read back: the last line of a nation is that of its largest customer."""
    g, customers = _nations(spark, sf_dir), _table(spark, sf_dir, "customer")
    own = F.round(F.abs("c_acctbal")).cast("long").cast("string").alias("weight")
    there = customers.select(F.col("c_custkey").cast("long").alias("v"), F.col("c_nationkey").cast("long").alias("e"), own)
    path = scratch(spark, "weighted-text")
    adjacency_text.write_adjacency(Hypergraph(g.vertices, g.hyperedges, there, g.e2v.withColumn("weight", F.lit("1"))), path, weighted=True)
    back = adjacency_text.read_adjacency(spark, path)
    return back.hyperedges.select("id", F.col("weight").cast("long").alias("weight"))


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.array_join("neighbours", ",").alias("neighbours"))


def _cut(spark: SparkSession, sf_dir: str) -> layout.Layout:
    return layout.build(order_part(spark, sf_dir), PARTS)


def _written(spark: SparkSession, sf_dir: str, graph: Hypergraph, kind: str) -> layout.Layout:
    path = scratch(spark, kind)
    layout.write(layout.build(graph, PARTS), path, "overwrite")
    return layout.read(spark, path)


def _layout_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank over OP written as a layout and read back. Programs use incidences twice, so those that have to be joined are stored."""
    g = layout.to_hypergraph(_written(spark, sf_dir, order_part(spark, sf_dir), "layout-rank"), mirrored=True)
    return _rounded(run_algorithm("page-rank", replace(g, e2v=written(g.e2v, "layout-back")), 3).vertices)


def _layout_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the uniques of a layout, through the text that it is exported to."""
    path = scratch(spark, "weights")
    layout.write_weights(layout.build(order_part_weighted(spark, sf_dir), PARTS), path, "overwrite")
    return layout.read_weights(spark, f"{path}/unique_weights").select(F.col("part").cast("long").alias("part"), "id", F.col("weight").cast("long").alias("weight"))


def _partitioned(spark: SparkSession, sf_dir: str) -> Hypergraph:
    """NC written as text, cut by the ``partition`` command and read back."""
    path = scratch(spark, "commands")
    adjacency_text.write_adjacency(_nations(spark, sf_dir), f"{path}/text", weighted=True)
    return layout.to_hypergraph(layout.partition(spark, f"{path}/text", PARTS, f"{path}/layout", mode="overwrite"))


def _layout_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = _written(spark, sf_dir, order_part(spark, sf_dir), "layout-meta").meta
    return spark.createDataFrame([(meta["uniques_as_hyperedges"], meta["total_replica_elements"], meta["total_unique_elements"])], "uniques_as_hyperedges boolean, total_replica_elements long, total_unique_elements long")


#: A program that uses the number of the superstep: the first one in which a vertex was reached from the source, plus one.
FIRST_REACHED = HyperProgram(
    vertex=Side(
        initial=lambda: F.when(F.col("id") == 0, F.lit(0).cast("long")), message=lambda step: (step + 1).cast("long"), apply=lambda: F.coalesce("value", "inbox"),
        activate=lambda: F.col("value").isNull(), starts_active=lambda: F.col("id") == 0,
    ),
    edge=Side(
        initial=lambda: F.lit(None).cast("long"), message=lambda _: F.col("value"), apply=lambda: F.coalesce("value", "inbox"),
        activate=lambda: F.col("value").isNull(), starts_active=lambda: F.lit(False),
    ),
    reduce=F.min,
)


#: Addressed messages: hyperedges tell how large they are, and every vertex writes to the smallest of its hyperedges only (of equals, the one
#: with the smaller id), once for each incidence with it.
PROPOSALS = HyperProgram(
    vertex=Side(
        state="choice_degree long, choice long", initial=lambda: {"choice_degree": F.lit(None), "choice": F.lit(None)}, starts_active=lambda: F.lit(False),
        inbox=lambda: {"smallest": F.min(F.struct("size", "edge"))}, apply=lambda: {"choice_degree": F.col("smallest.size"), "choice": F.col("smallest.edge")}, activate=lambda: F.lit(True),
        message=lambda _: {"proposer": F.col("id")}, to=lambda: F.when(F.col("dst") == F.col("choice"), F.col("dst")),
    ),
    edge=Side(
        state="n long, least long", initial=lambda: {"n": F.lit(0), "least": F.lit(None)}, message=lambda _: {"size": F.col("degree"), "edge": F.col("id")},
        inbox=lambda: {"n_heard": F.count("*"), "least_heard": F.min("proposer")}, apply=lambda: {"n": F.col("n") + F.col("n_heard"), "least": F.least("least", "least_heard")}, activate=lambda: F.lit(False),
    ),
)


def _range_side(**start) -> Side:
    return Side(
        state="low long, high long, n long", initial=lambda: {k: F.col(v) if isinstance(v, str) else F.lit(v) for k, v in start.items()},
        message=lambda _: {k: F.col(k) for k in ("low", "high", "n")}, inbox=lambda: {"low_heard": F.min("low"), "high_heard": F.max("high"), "n_heard": F.sum("n")},
        apply=lambda: {"low": F.least("low", "low_heard"), "high": F.greatest("high", "high_heard"), "n": F.col("n_heard")}, activate=lambda: F.lit(True),
    )


#: States of three fields: the smallest and the largest vertex id around, and along how many paths they were heard of.
RANGES = HyperProgram(vertex=_range_side(low="id", high="id", n=1), edge=_range_side(low=None, high=None, n=0), needs_limit=True)


def largest_three(table: pa.Table) -> pa.Table:
    """Of lists of (degree, id), the three with the largest degrees for each receiver, the smaller id of equals first."""
    lists = table.column("message").combine_chunks()
    dst = np.repeat(table.column("dst").to_numpy(), lists.value_lengths().to_numpy())
    degree, own = (lists.flatten().field(k).to_numpy() for k in ("degree", "id"))
    order = np.lexsort((own, -degree, dst))
    starts = np.flatnonzero(np.diff(dst[order], prepend=dst[order][:1] - 1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    order = order[rank < 3]
    heard, sizes = np.unique(dst[order], return_counts=True)
    values = pa.StructArray.from_arrays([pa.array(degree[order]), pa.array(own[order])], names=["degree", "id"])
    merged = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)
    return pa.table([pa.array(heard), merged], schema=table.schema)


_LARGEST = "array<struct<degree:long,id:long>>"

#: A reduction in Python: the three largest vertices of every hyperedge.
LARGEST_MEMBERS = HyperProgram(
    vertex=Side(
        initial=lambda: F.lit(None).cast(_LARGEST), message=lambda _: F.array(F.struct("degree", "id")), apply=lambda: F.col("inbox"), activate=lambda: F.lit(False),
    ),
    edge=Side(
        initial=lambda: F.lit(None).cast(_LARGEST), message=lambda _: F.col("value"), apply=lambda: F.col("inbox"), activate=lambda: F.lit(False), starts_active=lambda: F.lit(False),
    ),
    reduce=F.first, merge=largest_three,
)


def _trace(result) -> DataFrame:
    return result.trace


_MEMBER_SQL = "SELECT id // 2 AS id, lab AS value FROM cc WHERE id % 2 = {odd}"
_SOURCE = 0


def _long_paths() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """Components, paths and a program of a user over all line items."""
    op, weighted = order_part, order_part_weighted
    reached = " FROM (SELECT DISTINCT v FROM inc) LEFT JOIN sp ON sp.id = v AND EXISTS (SELECT 1 FROM inc WHERE v = 0)"
    return {
        "cc_hyperedges": (lambda s, d: _values(connected_components(op(s, d)).hyperedges), _component_ctes(_OP) + _MEMBER_SQL.format(odd=0)),
        "cc_k2": (
            lambda s, d: _values(connected_components(op(s, d), 1).vertices),
            f"WITH inc AS ({_OP}), r AS (SELECT v, max(e) AS x FROM inc GROUP BY v), u AS (SELECT e, max(x) AS x FROM r JOIN inc USING (v) GROUP BY e) SELECT v AS id, max(x) AS value FROM u JOIN inc USING (e) GROUP BY v",
        ),
        "cc_dual": (lambda s, d: _values(connected_components(op(s, d).dual()).hyperedges), _component_ctes(f"SELECT v AS e, e AS v FROM ({_OP})") + _MEMBER_SQL.format(odd=0)),
        "sssp_weighted": (lambda s, d: _values(shortest_path(weighted(s, d), _SOURCE).vertices), _path_ctes(str(_SOURCE), _OP) + " SELECT v AS id, d AS value" + reached),
        "sssp_limit": (
            lambda s, d: _values(shortest_path(weighted(s, d), _SOURCE, 2).vertices),
            f"WITH inc AS ({_OP}), len AS (SELECT l_orderkey AS e, 1 + count(*) FILTER (l_quantity < {BULK_QUANTITY}) AS len FROM lineitem GROUP BY 1), "
            f"near AS (SELECT y.v, min(len) AS d FROM inc x JOIN inc y USING (e) JOIN len USING (e) WHERE x.v = {_SOURCE} GROUP BY y.v) "
            f"SELECT i.v AS id, CASE WHEN i.v = {_SOURCE} THEN 0 ELSE d END AS value FROM (SELECT DISTINCT v FROM inc) i LEFT JOIN near USING (v)",
        ),
        "sssp_unreachable": (
            lambda s, d: shortest_path(weighted(s, d), _SOURCE).vertices.agg(F.count_if(F.col("value").isNull()).alias("unreachable"), F.max("value").alias("furthest")),
            _path_ctes(str(_SOURCE), _OP) + " SELECT count(*) FILTER (d IS NULL) AS unreachable, max(d) AS furthest" + reached,
        ),
        "custom_program": (
            lambda s, d: _values(run(op(s, d), LEAST_LABEL, EDGE).vertices),
            f"WITH RECURSIVE inc AS ({_OP}), hop AS (SELECT DISTINCT x.v AS a, y.v AS b FROM inc x JOIN inc y USING (e)), least(id, lab) USING KEY (id) AS (SELECT DISTINCT v, v FROM inc UNION "
            "SELECT hop.b, min(least.lab) FROM least JOIN hop ON hop.a = least.id JOIN recurring.least AS r ON r.id = hop.b WHERE least.lab < r.lab GROUP BY hop.b) SELECT id, lab AS value FROM least",
        ),
    }


def _catalogue() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    op, part = order_part, _placed
    copies_sql = f"held AS (SELECT v AS id, e % {PARTS} AS part, count(*) AS n_local FROM inc GROUP BY 1, 2), masters AS (SELECT id, min(part) AS master FROM held GROUP BY id)"
    ids_sql = f"SELECT id, (row_number() OVER (PARTITION BY master ORDER BY id) - 1) * {PARTS} + master AS new_id FROM masters"
    return {
        "incidence_v2e": (lambda s, d: op(s, d).v2e, _OP),
        "incidence_e2v": (lambda s, d: op(s, d).e2v, f"SELECT e, v FROM ({_OP})"),
        "dual": (lambda s, d: op(s, d).dual().v2e, f"SELECT e AS v, v AS e FROM ({_OP})"),
        "vertex_degree": (lambda s, d: op(s, d).vertex_degree(), f"SELECT v AS id, count(*) AS degree FROM ({_OP}) GROUP BY v"),
        "hyperedge_degree": (lambda s, d: order_part_isolated(s, d).hyperedge_degree(), "SELECT o_orderkey AS id, count(l_orderkey) AS degree FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
        "adjacency_lists": (
            lambda s, d: op(s, d).adjacency().select("id", F.array_join("neighbours", ",").alias("neighbours")),
            f"SELECT v AS id, string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) AS neighbours FROM ({_OP}) GROUP BY v",
        ),
        "page_rank_k1": (lambda s, d: _rounded(page_rank(op(s, d), 1).vertices), _rank_sql(1)),
        "page_rank_k3": (lambda s, d: _rounded(page_rank(op(s, d), 3).vertices), _rank_sql(3)),
        "page_rank_k10": (lambda s, d: _rounded(page_rank(op(s, d), 10).vertices), _rank_sql(10)),
        "page_rank_hyperedge_scores": (lambda s, d: _rounded(page_rank(op(s, d), 2, unique_side=VERTEX).hyperedges), _rank_sql(2, "e")),
        "page_rank_top20": (
            lambda s, d: _rounded(page_rank(op(s, d), 3).vertices).orderBy(F.desc("value"), "id").limit(20),
            f"SELECT * FROM ({_rank_sql(3)}) ORDER BY value DESC, id LIMIT 20",
        ),
        "page_rank_dual": (lambda s, d: _rounded(page_rank(op(s, d).dual(), 2).vertices), _rank_sql(2, dual=True)),
        "page_rank_isolated": (lambda s, d: _rounded(page_rank(order_part_isolated(s, d).dual(), 2).vertices), f"SELECT o_orderkey AS id, coalesce(value, 1.0) AS value FROM orders LEFT JOIN ({_rank_sql(2, dual=True)}) ON id = o_orderkey"),
        "cc_fixpoint": (lambda s, d: _values(connected_components(op(s, d)).vertices), _component_ctes(_OP) + _MEMBER_SQL.format(odd=1)),
        "cc_forests": (lambda s, d: _values(forests.connected(op(s, d), FOREST_LINKS).vertices), _component_ctes(_OP) + _MEMBER_SQL.format(odd=1)),
        "cc_forests_isolated": (
            lambda s, d: _values(forests.connected(order_part_isolated(s, d), FOREST_LINKS).hyperedges),
            _component_ctes(_OP) + f" SELECT o_orderkey AS id, coalesce(value, o_orderkey) AS value FROM orders LEFT JOIN ({_MEMBER_SQL.format(odd=0)}) ON id = o_orderkey",
        ),
        "sssp_buckets": (
            lambda s, d: _values(shortest_path(order_part_weighted(s, d), _SOURCE, delta=BUCKET).vertices),
            _path_ctes(str(_SOURCE), _OP) + " SELECT v AS id, d AS value FROM (SELECT DISTINCT v FROM inc) LEFT JOIN sp ON sp.id = v AND EXISTS (SELECT 1 FROM inc WHERE v = 0)",
        ),
        "cc_component_sizes": (
            lambda s, d: connected_components(nation_customer(s, d)).vertices.groupBy("value").agg(F.count("*").alias("n")),
            "SELECT c_nationkey AS value, count(*) AS n FROM customer GROUP BY 1",
        ),
        "sssp_hops": (
            lambda s, d: _values(shortest_path(op(s, d), _SOURCE).vertices),
            _path_ctes(str(_SOURCE), _OP, unit=True) + " SELECT v AS id, d AS value FROM (SELECT DISTINCT v FROM inc) LEFT JOIN sp ON sp.id = v",
        ),
        "sssp_dual": (
            lambda s, d: _values(shortest_path(nation_customer(s, d).dual(), _SOURCE).vertices),
            "SELECT DISTINCT c_nationkey::BIGINT AS id, CASE WHEN c_nationkey = 0 THEN 0::BIGINT END AS value FROM customer",
        ),
        "lp_k1": (lambda s, d: _values(label_propagation(op(s, d), 1).vertices), _label_sql(1) + " SELECT v AS id, lab AS value FROM l1"),
        "lp_k3": (lambda s, d: _values(label_propagation(op(s, d), 3).vertices), _label_sql(3) + " SELECT v AS id, lab AS value FROM l3"),
        "lp_community_sizes": (
            lambda s, d: label_propagation(op(s, d), 3).vertices.groupBy("value").agg(F.count("*").alias("n")),
            _label_sql(3) + " SELECT lab AS value, count(*) AS n FROM l3 GROUP BY lab",
        ),
        "half_step_sum": (
            lambda s, d: _rounded(_first_half(s, d, PAGE_RANK)),
            f"WITH inc AS ({_OP}), vd AS (SELECT v, count(*) AS d FROM inc GROUP BY v) SELECT e AS id, round(sum(1.0::DOUBLE / d), 6) AS value FROM inc JOIN vd USING (v) GROUP BY e",
        ),
        "half_step_max": (lambda s, d: _values(_first_half(s, d, components_program(EDGE))), f"WITH inc AS ({_OP}), r AS (SELECT v, max(e) AS x FROM inc GROUP BY v) SELECT e AS id, max(x) AS value FROM inc JOIN r USING (v) GROUP BY e"),
        "half_step_min": (lambda s, d: _values(_first_half(s, d, shortest_path_program(_SOURCE))), f"SELECT e AS id, min(CASE WHEN v = {_SOURCE} THEN 0::BIGINT END) AS value FROM ({_OP}) GROUP BY e"),
        "half_step_hist": (lambda s, d: _values(_first_half(s, d, label_program(EDGE))), _label_sql(1) + " SELECT e AS id, lab AS value FROM m1"),
        "active_trace_sssp": (
            lambda s, d: _trace(shortest_path(nation_customer(s, d), _SOURCE, trace=True)),
            f"WITH n AS (SELECT count(DISTINCT c_nationkey) AS e, count(*) AS v, (SELECT count(*) FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = {_SOURCE})) AS k FROM customer) "
            "SELECT 0::INT AS superstep, 0::BIGINT AS active_replicas, e AS total_replicas, 1::BIGINT AS active_uniques, v AS total_uniques FROM n UNION ALL SELECT 1, 1, e, k - 1, v FROM n UNION ALL SELECT 2, 0, e, 0, v FROM n WHERE FALSE",
        ),
        "active_trace_cc": (
            lambda s, d: _trace(connected_components(nation_customer(s, d), 1, trace=True)),
            "SELECT 0::INT AS superstep, count(*) AS active_replicas, count(*) AS total_replicas, count(DISTINCT c_nationkey) AS active_uniques, count(DISTINCT c_nationkey) AS total_uniques FROM customer",
        ),
        "partition_mod": (lambda s, d: part(s, d)[1], f"SELECT DISTINCT l_orderkey AS id, l_orderkey % {PARTS} AS part FROM lineitem"),
        "partition_user": (_by_priority, "SELECT DISTINCT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey"),
        "replicas_by_partition": (lambda s, d: part(s, d)[2], f"WITH inc AS ({_OP}), {copies_sql} SELECT * FROM held"),
        "master_assignment": (lambda s, d: placement.masters(part(s, d)[2]), f"WITH inc AS ({_OP}), {copies_sql} SELECT * FROM masters"),
        "servant_map": (lambda s, d: placement.servants(part(s, d)[2]), f"WITH inc AS ({_OP}), {copies_sql} SELECT id, part FROM held JOIN masters USING (id) WHERE part <> master"),
        "new_ids": (lambda s, d: placement.new_ids(part(s, d)[2], PARTS), f"WITH inc AS ({_OP}), {copies_sql} SELECT id, (row_number() OVER (PARTITION BY master ORDER BY id) - 1) * {PARTS} + master AS new_id FROM masters"),
        "replication_factor": (
            lambda s, d: placement.replication(part(s, d)[2]).withColumn("factor", F.round("factor", 6)),
            f"WITH inc AS ({_OP}), {copies_sql} SELECT count(DISTINCT id) AS replicas, count(*) AS copies, round(count(*) / count(DISTINCT id), 6) AS factor FROM held",
        ),
        "weights_last_wins": (_last_weights, "SELECT c_nationkey::BIGINT AS id, arg_max(CAST(round(abs(c_acctbal)) AS BIGINT), c_custkey) AS weight FROM customer GROUP BY 1 UNION ALL SELECT n_nationkey::BIGINT, NULL FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)"),
        "replicas_isolated": (
            lambda s, d: placement.copies((g := order_part_isolated(s, d)).hyperedges, g.e2v.select(F.col("e").alias("src"), F.col("v").alias("dst")), placement.by_modulo(g.vertices, PARTS), PARTS),
            f"SELECT l_orderkey AS id, l_partkey % {PARTS} AS part, count(*) AS n_local FROM lineitem GROUP BY 1, 2 UNION ALL SELECT o_orderkey, o_orderkey % {PARTS}, 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
        ),
        "replica_layout": (
            lambda s, d: _joined(_cut(s, d).replicas.withColumn("part", F.col("part").cast("long")), "part", "old_id", "new_id", "total_degree"),
            f"WITH inc AS ({_OP}), {copies_sql}, ids AS ({ids_sql}), lists AS (SELECT v, e % {PARTS} AS part, string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) AS neighbours FROM inc GROUP BY 1, 2) "
            "SELECT part, v AS old_id, new_id, (SELECT count(*) FROM inc WHERE inc.v = lists.v) AS total_degree, neighbours FROM lists JOIN ids ON ids.id = v",
        ),
        "unique_layout": (
            lambda s, d: _joined(_cut(s, d).uniques.withColumn("part", F.col("part").cast("long")), "part", "id"),
            f"WITH inc AS ({_OP}), {copies_sql}, ids AS ({ids_sql}) SELECT e % {PARTS} AS part, e AS id, string_agg(CAST(new_id AS VARCHAR), ',' ORDER BY new_id) AS neighbours FROM inc JOIN ids ON ids.id = v GROUP BY 1, 2",
        ),
        "master_layout": (
            lambda s, d: _cut(s, d).masters.select(F.col("part").cast("long").alias("part"), "new_id", F.array_join(F.col("servant_parts").cast("array<string>"), ",").alias("servant_parts")),
            f"WITH inc AS ({_OP}), {copies_sql}, ids AS ({ids_sql}) SELECT master AS part, new_id, string_agg(CAST(part AS VARCHAR), ',' ORDER BY part) AS servant_parts FROM held JOIN masters USING (id) JOIN ids USING (id) WHERE part <> master GROUP BY 1, 2",
        ),
        "layout_meta": (_layout_meta, "SELECT true AS uniques_as_hyperedges, count(DISTINCT l_partkey) AS total_replica_elements, count(DISTINCT l_orderkey) AS total_unique_elements FROM lineitem"),
        "layout_weights": (_layout_weights, f"SELECT l_orderkey % {PARTS} AS part, l_orderkey AS id, 1 + count(*) FILTER (l_quantity < {BULK_QUANTITY}) AS weight FROM lineitem GROUP BY 1, 2"),
        "layout_roundtrip": (
            lambda s, d: (g := layout.to_hypergraph(_written(s, d, op(s, d), "layout"))).v2e.withColumn("kind", F.lit("v2e")).unionByName(g.e2v.withColumn("kind", F.lit("e2v"))),
            f"SELECT v, e, 'v2e' AS kind FROM ({_OP}) UNION ALL SELECT v, e, 'e2v' FROM ({_OP})",
        ),
        "layout_page_rank": (_layout_rank, _rank_sql(3)),
        "command_components": (
            lambda s, d: _values(run_algorithm("connected-component", _partitioned(s, d)).vertices),
            "SELECT c_custkey::BIGINT AS id, c_nationkey::BIGINT AS value FROM customer",
        ),
        "command_shortest_paths": (
            lambda s, d: _values(run_algorithm("shortest-path", _partitioned(s, d), source=_SOURCE).vertices),
            f"WITH home AS (SELECT c_nationkey AS e FROM customer WHERE c_custkey = {_SOURCE}) SELECT c_custkey::BIGINT AS id, CASE WHEN c_custkey = {_SOURCE} THEN 0 WHEN c_nationkey = e THEN e + 3 END::BIGINT AS value FROM customer LEFT JOIN home ON true",
        ),
        "first_reached": (
            lambda s, d: _values(run(op(s, d), FIRST_REACHED).vertices),
            _path_ctes(str(_SOURCE), _OP, unit=True) + " SELECT v AS id, d AS value FROM (SELECT DISTINCT v FROM inc) LEFT JOIN sp ON sp.id = v AND EXISTS (SELECT 1 FROM inc WHERE v = 0)",
        ),
        "proposals": (
            lambda s, d: run(op(s, d), PROPOSALS).hyperedges.select("id", "n", "least"),
            f"WITH inc AS ({_OP}), ed AS (SELECT e, count(*) AS d FROM inc GROUP BY e), choice AS (SELECT v, arg_min(e, (d, e)) AS e FROM inc JOIN ed USING (e) GROUP BY v), "
            "heard AS (SELECT e, count(*) AS n, min(v) AS least FROM inc JOIN choice USING (v, e) GROUP BY e) SELECT e AS id, coalesce(n, 0) AS n, least FROM ed LEFT JOIN heard USING (e)",
        ),
        "two_hop_ranges": (
            lambda s, d: run(op(s, d), RANGES, limit=1).vertices.select("id", "low", "high", "n"),
            f"WITH inc AS ({_OP}), ed AS (SELECT e, min(v) AS low, max(v) AS high, count(*) AS n FROM inc GROUP BY e) SELECT v AS id, min(low) AS low, max(high) AS high, CAST(sum(n) AS BIGINT) AS n FROM inc JOIN ed USING (e) GROUP BY v",
        ),
        "largest_members": (
            lambda s, d: run(op(s, d), LARGEST_MEMBERS).hyperedges.select("id", F.array_join(F.transform("value", lambda x: x["id"].cast("string")), ",").alias("members")),
            f"WITH inc AS ({_OP}), vd AS (SELECT v, count(*) AS d FROM inc GROUP BY v), ranked AS (SELECT e, v, row_number() OVER (PARTITION BY e ORDER BY d DESC, v) AS r FROM inc JOIN vd USING (v)) "
            "SELECT e AS id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY r) AS members FROM ranked WHERE r <= 3 GROUP BY e",
        ),
        "csr_offsets": (
            lambda s, d: adjacency_text.csr_offsets((g := order_part_isolated(s, d)).hyperedges, g.e2v, "e"),
            "WITH n AS (SELECT o_orderkey AS id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT id, CAST(coalesce(sum(n) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM n",
        ),
        "csr_roundtrip": (
            _round_trip,
            "SELECT 'v2e' AS kind, c_custkey::BIGINT AS a, c_nationkey::BIGINT AS b FROM customer UNION ALL SELECT 'e2v', c_nationkey, c_custkey FROM customer "
            "UNION ALL SELECT 'weight', n_nationkey, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer) THEN n_nationkey + 3 END FROM nation",
        ),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in (_catalogue() | _long_paths()).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (_catalogue() | _long_paths()).items()}
