"""What a program sets up before its supersteps, and what it reads while few elements are active."""

import pytest
from pyspark.sql import functions as F
from test_supersteps import by_id

from knitwork.functions.programs import label_program, shortest_path_program
from knitwork.operators import forests
from knitwork.plans import catalogue, supersteps
from knitwork.plans.supersteps import EDGE, VERTEX, run
from knitwork.sources.hypergraph import Hypergraph, from_table


def net(spark):
    """A hot vertex, long and short ways, some incidences twice."""
    rows = spark.range(400).select((F.col("id") % 90).alias("e"), F.when(F.col("id") % 8 == 0, 5).otherwise(F.col("id") * 7 % 110).alias("v"))
    return rows.unionByName(rows.limit(50))


def weighted(spark):
    edges = spark.range(90).select("id", (F.col("id") * 5 % 13 + 1).cast("string").alias("weight"))
    return from_table(net(spark), "e", "v", hyperedges=edges)


def test_states_come_from_dealt_incidences(spark, monkeypatch):
    """cc_hyperedges: elements that are ends of incidences are not put together from the table, and degrees are counted where incidences lie;
    with hubs and without, the same as with element tables."""
    given, whole = [], supersteps.initial_state
    monkeypatch.setattr(supersteps, "initial_state", lambda elements, inc, side: given.append((elements is None, inc.storageLevel.useMemory)) or whole(elements, inc, side))
    g = from_table(net(spark), "e", "v")
    program = supersteps.HyperProgram(vertex=catalogue.RANGES.vertex, edge=catalogue.RANGES.edge, needs_limit=True)
    results = []
    for graph, hubs in ((g, 1_000_000), (g, 10), (Hypergraph(g.vertices, g.hyperedges, g.v2e, g.e2v, mirrored=True), 10)):
        found = run(graph, program, EDGE, 2, hub_incidences=hubs)
        results.append([by_id(x, "low", "high", "n") for x in (found.vertices, found.hyperedges)])
    assert results[0] == results[1] == results[2] and len(results[0][0]) == g.vertices.count()
    assert given[:2] == [(True, True)] * 2 and given[2][0] and not given[4][0]


@pytest.mark.parametrize("delta", [None, 3])
def test_lookups_read_columns_and_the_front_is_one_table(spark, monkeypatch, delta):
    """first_reached, sssp_buckets: the last full state is held as columns, and active elements are not put together from those of all steps before."""
    held, fronts, heard = [], [], supersteps._Population.hear_few

    def hear_few(self, inbox, reached):
        held.append((self.base.held, self.base.table.storageLevel.useMemory))
        out = heard(self, inbox, reached)
        if self.table is None:
            fronts.append(self.front._jdf.queryExecution().analyzed().collectLeaves().length())
        return out

    g, program = weighted(spark), shortest_path_program(5, delta)
    want = run(g, program, VERTEX, sparse=0.0)
    monkeypatch.setattr(supersteps._Population, "hear_few", hear_few)
    found = run(g, program, VERTEX, sparse=9.0)
    assert held and all(x == (True, True) for x in held) and max(fronts) == 1
    assert found.supersteps == want.supersteps and by_id(found.vertices, "value", "active") == by_id(want.vertices, "value", "active") and by_id(found.hyperedges, "value") == by_id(want.hyperedges, "value")
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_small_labels_are_compared_as_numbers(spark):
    """lp_k3: no sort for the most frequent label; the same as for ids that do not fit, of which ties go to the smaller as well."""
    sent = net(spark).select(F.col("e").alias("dst"), (F.col("v") % 9).alias("message"))
    sent = sent.unionByName(spark.createDataFrame([(200, 0), (200, supersteps.SMALL - 1), (201, supersteps.SMALL - 1)], "dst long, message long"))
    program = label_program(EDGE)
    small, any_id = program.combine_small(sent), program.combine(sent)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, any_id.collect()))
    assert "SortAggregate" not in small._jdf.queryExecution().executedPlan().toString()
    shift = 1 << 40
    g, far = from_table(net(spark), "e", "v"), from_table(net(spark).select("e", (F.col("v") + shift).alias("v")), "e", "v")
    near = by_id(run(g, program, EDGE, 2).vertices, "value")
    assert by_id(run(far, program, EDGE, 2).vertices, "value") == {k + shift: (v + shift,) for k, (v,) in near.items()}


def test_forests_take_mirrored_links_once(spark, monkeypatch):
    """cc_forests: each incidence is one link, unless the two relations may differ."""
    counted, whole = [], forests.components
    monkeypatch.setattr(forests, "components", lambda links, *a: counted.append(links.count()) or whole(links, *a))
    g = from_table(net(spark), "e", "v")
    once, twice = (forests.connected(x, 40) for x in (g, Hypergraph(g.vertices, g.hyperedges, g.v2e, g.e2v)))
    assert counted == [450, 900] and by_id(once.vertices, "value") == by_id(twice.vertices, "value") and by_id(once.hyperedges, "value") == by_id(twice.hyperedges, "value")
