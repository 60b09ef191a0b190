"""Messages are dealt to tasks before they are reduced, where no receiver is hot."""

from pyspark.sql import functions as F
from test_supersteps import by_id, chain, fixed_plans

from knitwork.functions import programs
from knitwork.functions.programs import shortest_path_program
from knitwork.plans import catalogue, supersteps
from knitwork.plans.supersteps import EDGE, Incidence, gather, initial_state, messages, run
from knitwork.sources.hypergraph import Hypergraph, from_table


def operators(df):
    """Nodes of the plan from the top, with their rows written to exchanges; of adaptive plans those that were run."""
    df.write.format("noop").mode("overwrite").save()
    df._jdf.queryExecution().toRdd().count()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        found.append((node.nodeName(), node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else None))
        todo += [node.children().apply(k) for k in range(node.children().length())]
    return found


def test_messages_are_dealt_before_they_are_reduced(spark):
    """One exchange of all messages with nothing reduced below it, and the same inboxes."""
    g = chain(spark, 300)
    inc = g.v2e.withColumnsRenamed({"v": "src", "e": "dst"})
    for program in (programs.PAGE_RANK, programs.label_program(EDGE)):
        with fixed_plans(spark, 3):
            state = initial_state(g.vertices, inc, program.vertex)
            state = spark.createDataFrame(state.collect(), state.schema)
            sent = messages(state, Incidence(spark.createDataFrame(inc.collect(), inc.schema)), program.vertex)
            dealt, before = gather(sent, program, program.edge, 3)[0], gather(sent, program, program.edge)[0]
            assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, before.collect()))
            names = operators(dealt)
        exchanges_of_messages = [k for k, (name, n) in enumerate(names) if name == "Exchange" and n == 600]
        first = exchanges_of_messages[0]
        assert not any("Exchange" in name for name, _ in names[:first]) and not any("Aggregate" in name for name, _ in names[first:])


def test_hot_receivers_are_reduced_before_the_exchange(spark, monkeypatch):
    """Everything goes to one hyperedge; its messages are dealt only where it counts as no hub."""
    given = []
    whole = supersteps.gather
    monkeypatch.setattr(supersteps, "gather", lambda sent, program, receiver, parts=None: given.append(parts) or whole(sent, program, receiver, parts))
    g = from_table(spark.range(400).select(F.lit(0).alias("e"), F.col("id").alias("v")).unionByName(spark.range(200).select((F.col("id") + 1).alias("e"), F.col("id").alias("v"))), "e", "v")
    ranks = [by_id(run(graph, programs.PAGE_RANK, limit=1, hub_incidences=hubs).vertices, "value") for graph, hubs in ((g, 1000), (g, 10), (Hypergraph(g.vertices, g.hyperedges, g.v2e, g.e2v), 1000))]
    assert given == [4, 4, None, 4, None, None]
    for found in ranks[1:]:
        assert found.keys() == ranks[0].keys() and all(abs(found[k][0] - v[0]) < 1e-9 for k, v in ranks[0].items())


def test_incidences_are_kept_as_columns(spark):
    """No list for each sender has to be made and opened again."""
    inc = chain(spark, 50).v2e.withColumnsRenamed({"v": "src", "e": "dst"})
    with fixed_plans(spark):
        kept = Incidence.of(inc, initial_state(chain(spark, 50).vertices, inc, shortest_path_program(0).vertex), 100, 4, 1_000_000)
        assert kept.dealt.columns == ["src", "dst"] and sorted(map(tuple, kept.dealt.collect())) == sorted(map(tuple, inc.collect()))
        kept.release()


def test_a_half_step_deals_messages_into_a_fixed_number_of_partitions(spark):
    """half_step_hist: tasks that reduce do not grow with the size of what is scanned or put together before them."""
    plan = catalogue.queries()["half_step_hist"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
