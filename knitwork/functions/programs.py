"""The four built-in programs: PageRank, connected components, shortest paths and label propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knitwork.plans.supersteps import EDGE, SMALL, VERTEX, HyperProgram, Result, Side, run
from knitwork.sources.hypergraph import Hypergraph

# Fixed value: the share of a vertex's importance that does not depend on its neighbours.
ALPHA = 0.15

_inbox = lambda: F.col("inbox")
_yes = lambda: F.lit(True)


def _rank_side(initial: float, damped: bool) -> Side:
    share = (lambda _: (F.lit(ALPHA) + F.lit(1 - ALPHA) * F.col("value")) / F.col("degree")) if damped else (lambda _: F.col("value") / F.col("degree"))
    return Side(
        initial=lambda: F.lit(initial), message=share, apply=lambda: F.col("value") + F.col("inbox"), activate=_yes,
        after_send=lambda: F.lit(0.0), stays_active=True, can_send=lambda: F.col("degree") > 0,
    )


#: Vertices are damped; what an element without out-neighbours receives stays with it.
PAGE_RANK = HyperProgram(vertex=_rank_side(1.0, True), edge=_rank_side(0.0, False), reduce=F.sum, needs_limit=True)


def _component_side(initial: str) -> Side:
    return Side(
        initial=lambda: F.col(initial), message=lambda _: F.col("value"), apply=lambda: F.when(F.col("value").isNotNull(), F.greatest("value", "inbox")),
        activate=lambda: F.col("inbox") > F.col("value"), can_send=lambda: F.col("value").isNotNull(),
    )


def components_program(unique_side: str = EDGE) -> HyperProgram:
    """Largest unique id reached. Replicas start from their largest out-neighbour (null without any), uniques from themselves."""
    replica, unique = _component_side("high"), _component_side("id")
    return HyperProgram(vertex=replica if unique_side == EDGE else unique, edge=unique if unique_side == EDGE else replica, reduce=F.max)


def _distance_side(length: Column | None, source: int | None) -> Side:
    at_source = F.lit(False) if source is None else F.col("id") == source
    start = F.when(at_source, F.lit(0).cast("long"))
    cost = F.col("value") if length is None else F.col("value") + length
    return Side(
        initial=lambda: start, message=lambda _: cost, apply=lambda: F.least("value", "inbox"), activate=lambda: F.col("value").isNull() | (F.col("inbox") < F.col("value")),
        starts_active=lambda: at_source, due=lambda: cost,
    )


def shortest_path_program(source: int = 0, delta: int | None = None) -> HyperProgram:
    """Least sum of the lengths of hyperedges crossed; a hyperedge's own value is what it costs to reach it.

    With ``delta``, lengths are taken in buckets of that width (delta-stepping): nothing is sent whose length lies beyond the bucket of the
    least one. So incidences of light hyperedges are followed within a bucket, heavy ones once their bucket comes, when their start has
    usually become final.
    """
    return HyperProgram(bucket=delta, vertex=_distance_side(None, source), edge=_distance_side(F.coalesce(F.col("weight").cast("long"), F.lit(1)), None), reduce=F.min)


def _most_frequent(sent: DataFrame) -> DataFrame:
    """The most frequent message to each receiver, the smallest of equals; counts are combined before the exchange."""
    counts = sent.groupBy("dst", "message").agg(F.count("*").alias("n"))
    best = counts.groupBy("dst").agg(F.max(F.struct("n", (-F.col("message")).alias("low"))).alias("best"))
    return best.select("dst", (-F.col("best.low")).alias("inbox"))


def _most_frequent_small(sent: DataFrame) -> DataFrame:
    """The same for messages from 0 to below SMALL: count and message are compared as one number, which needs no sorting."""
    counts = sent.groupBy("dst", "message").agg(F.count("*").alias("n"))
    best = counts.groupBy("dst").agg(F.max(F.col("n") * F.lit(SMALL) + (F.lit(SMALL - 1) - F.col("message"))).alias("best"))
    return best.select("dst", (F.lit(SMALL - 1) - F.pmod("best", F.lit(SMALL))).alias("inbox"))


def _label_side(initial: Column) -> Side:
    return Side(
        initial=lambda: initial, message=lambda _: F.col("value"), apply=_inbox, activate=_yes,
        after_send=lambda: F.lit(None).cast("long"), stays_active=True, can_send=lambda: F.col("value").isNotNull(),
    )


def label_program(unique_side: str = EDGE) -> HyperProgram:
    """Replicas vote with their own id at first; uniques pass on the most frequent label. Votes are cleared once sent."""
    own, none = F.col("id"), F.lit(None).cast("long")
    v, e = (own, none) if unique_side == EDGE else (none, own)
    return HyperProgram(vertex=_label_side(v), edge=_label_side(e), combine=_most_frequent, combine_small=_most_frequent_small, needs_limit=True)


def page_rank(graph: Hypergraph, supersteps: int, unique_side: str = EDGE, trace: bool = False) -> Result:
    return run(graph, PAGE_RANK, unique_side, supersteps, trace)


def connected_components(graph: Hypergraph, limit: int | None = None, unique_side: str = EDGE, trace: bool = False) -> Result:
    return run(graph, components_program(unique_side), unique_side, limit, trace)


def shortest_path(graph: Hypergraph, source: int = 0, limit: int | None = None, unique_side: str = VERTEX, trace: bool = False, delta: int | None = None) -> Result:
    return run(graph, shortest_path_program(source, delta), unique_side, limit, trace)


def label_propagation(graph: Hypergraph, supersteps: int, unique_side: str = EDGE, strict: bool = False, trace: bool = False) -> Result:
    """``strict`` raises where a unique has nothing to pass on."""
    if strict:
        uniques, inc, key = (graph.hyperedges, graph.v2e, "e") if unique_side == EDGE else (graph.vertices, graph.e2v, "v")
        if uniques.join(inc, uniques["id"] == inc[key], "left_anti").take(1):
            raise ValueError("an element receives no label")
    return run(graph, label_program(unique_side), unique_side, supersteps, trace)


ALGORITHMS = {"page-rank": page_rank, "connected-component": connected_components, "shortest-path": shortest_path, "label-propagation": label_propagation}


def run_algorithm(name: str, graph: Hypergraph, superstep_limit: int | None = None, source: int = 0, unique_side: str | None = None, compat: bool = False, trace: bool = False) -> Result:
    """By name. ``compat`` treats hyperedges as the ranked or source side, as the command line of older engines does by default."""
    if name not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {name!r}; one of {', '.join(ALGORITHMS)}")
    if compat and name in ("page-rank", "shortest-path"):
        found = run_algorithm(name, graph.dual(), superstep_limit, source, unique_side or VERTEX, False, trace)
        return Result(found.hyperedges, found.vertices, found.supersteps, found.converged, found.trace, found.written)
    kwargs = {"trace": trace} | ({"unique_side": unique_side} if unique_side else {})
    if name in ("page-rank", "label-propagation"):
        if superstep_limit is None:
            raise ValueError("this program never settles: give a superstep limit")
        return ALGORITHMS[name](graph, superstep_limit, **kwargs)
    return shortest_path(graph, source, superstep_limit, **kwargs) if name == "shortest-path" else connected_components(graph, superstep_limit, **kwargs)
