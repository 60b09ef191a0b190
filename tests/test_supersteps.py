"""Addressed messages, states of several fields, reductions in Python, and what few active elements read and write."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knitwork.functions.programs import components_program, shortest_path_program
from knitwork.plans import catalogue
from knitwork.plans.supersteps import EDGE, VERTEX, HyperProgram, Incidence, Side, gather, initial_state, messages, ranges_of, run
from knitwork.plans.supersteps import _fixed_plans as fixed_plans
from knitwork.sources import adjacency_text
from knitwork.sources.hypergraph import Hypergraph, from_table


def chain(spark, n, tail=0):
    """Vertices 0 ... n in a row, each two in a hyperedge; ``tail`` more in a hyperedge of their own."""
    rows = spark.range(n).select(F.col("id").alias("e"), F.explode(F.array("id", F.col("id") + 1)).alias("v"))
    rows = rows.unionByName(spark.range(tail).select(F.lit(n).alias("e"), (F.col("id") + n + 10).alias("v")))
    return from_table(rows, "e", "v")


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


CASES = [(EDGE, lambda: components_program(EDGE)), (VERTEX, lambda: shortest_path_program(2)), (EDGE, lambda: catalogue.FIRST_REACHED)]


@pytest.mark.parametrize(("unique_side", "program"), CASES, ids=["components", "paths", "first reached"])
def test_few_or_all_give_the_same(spark, unique_side, program):
    g = chain(spark, 6, 3)
    states = []
    for sparse in (0.0, 0.2, 9.0):  # never only changes, at times, always
        found = run(g, program(), unique_side, trace=True, sparse=sparse)
        states.append((found.supersteps, found.converged, [tuple(r) for r in found.trace.orderBy("superstep").collect()], by_id(found.vertices, "value", "active"), by_id(found.hyperedges, "value", "active")))
    assert all(x == states[0] for x in states)
    assert states[0][1]


def test_stops_at_limit_with_active_elements(spark):
    for sparse in (0.0, 9.0):
        found = run(chain(spark, 12), shortest_path_program(0), VERTEX, limit=3, sparse=sparse)
        assert not found.converged and found.supersteps == 3
        assert by_id(found.vertices, "value", "active")[2] == (2, False)
        got = by_id(found.hyperedges, "value", "active")
        assert got[1] == (1, False) and got[2] == (2, True) and got[3] == (None, False)


def test_written_rows_follow_the_active_ones(spark):
    """A path crosses a long chain: each superstep reaches one more vertex, and writes a few rows out of a thousand."""
    g = chain(spark, 500)
    found = run(g, shortest_path_program(0), VERTEX, limit=9, trace=True, sparse=0.05)
    active = [r["active_uniques"] + r["active_replicas"] for r in found.trace.orderBy("superstep").collect()]
    assert max(active) <= 4
    assert len(found.written) == 9 and sum(found.written) <= 8 * sum(active)  # each row once, and again when changes are merged
    all_rows = run(g, shortest_path_program(0), VERTEX, limit=2, sparse=0.0)
    assert all_rows.written[1] >= 1000


def scanned(df):
    """Rows that came out of tables kept in memory."""
    df.write.format("noop").mode("overwrite").save()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    df.collect()
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan In-memory") or "InMemoryTableScan" in node.getClass().getName():
            total += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(k) for k in range(node.children().length())]
    return total


def test_few_senders_read_few_chunks(spark):
    g = chain(spark, 60_000)
    inc = g.v2e.withColumnsRenamed({"v": "src", "e": "dst"})
    side = shortest_path_program(0).vertex
    with fixed_plans(spark):
        state = initial_state(g.vertices.repartition(4, "id"), inc, side)
        kept = Incidence.of(inc, state, 120_000, 4, 1_000_000)
        front = spark.createDataFrame([(7, 5), (8, 5), (59_000, 5)], "id long, value long")
        few, whole = (messages(front, kept, side, ids=ids) for ids in ([7, 8, 59_000], None))
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.collect())) == sorted([(6, 5), (7, 5), (7, 5), (8, 5), (58_999, 5), (59_000, 5)])
        assert 4 * scanned(few) <= scanned(whole)  # a join ends with its last sender, else it would be all
        kept.release()


def test_ranges():
    assert ranges_of([]) == []
    assert ranges_of([5]) == [(5, 5)]
    assert ranges_of([1, 2, 3, 50, 51, 900, 3], 3) == [(1, 3), (50, 51), (900, 900)]
    assert ranges_of(list(range(0, 1000, 10)), 4)[-1][1] == 990 and len(ranges_of(list(range(0, 1000, 10)), 4)) == 4


def test_hubs_and_long_lists_are_chunked(spark):
    """A vertex with 5,000 hyperedges, as a hub and not, with repeated incidences."""
    rows = spark.range(5000).select(F.col("id").alias("e"), F.lit(0).alias("v")).unionByName(spark.range(40).select(F.col("id").alias("e"), F.lit(1).alias("v")))
    rows = rows.unionByName(spark.range(3).select(F.col("id").alias("e"), F.lit(0).alias("v")))
    g = from_table(rows, "e", "v")
    program = HyperProgram(
        vertex=Side(initial=lambda: F.lit(1).cast("long"), message=lambda _: F.col("value"), apply=lambda: F.col("inbox"), activate=lambda: F.lit(False)),
        edge=Side(initial=lambda: F.lit(0).cast("long"), message=lambda _: F.col("value"), apply=lambda: F.col("inbox"), activate=lambda: F.lit(True)), reduce=F.sum,
    )
    for hubs in (1_000_000, 100):
        found = run(g, program, limit=1, hub_incidences=hubs)
        assert by_id(found.hyperedges, "value") == {k: (1 + (k < 40) + (k < 3),) for k in range(5000)}
        assert by_id(found.vertices, "value") == {0: (5000 + 40 + 2 * 3 + 3 * 2,), 1: (80 + 3,)}


def test_messages_to_chosen_receivers(spark):
    """Attributes of incidences decide what is sent; a receiver need not be a neighbour; unknown ones hear nothing and harm nothing."""
    elements = lambda n: spark.createDataFrame([(k, None) for k in range(n)], "id long, weight string")
    v2e = spark.createDataFrame([(0, 0, 5), (0, 1, 7), (1, 1, 9), (1, 1, 2), (2, 0, 1)], "v long, e long, price long")
    g = Hypergraph(elements(3), elements(4), v2e, v2e.select("e", "v"))
    none = Side(initial=lambda: {"dearest": F.lit(None).cast("long"), "n": F.lit(0)}, state="dearest long, n int", starts_active=lambda: F.lit(False), message=lambda _: F.col("n"),
                inbox=lambda: {"best": F.max("offer"), "count_heard": F.count("*")}, apply=lambda: {"dearest": F.col("best"), "n": F.col("count_heard").cast("int")}, activate=lambda: F.lit(False))
    buyers = Side(initial=lambda: F.lit(0), message=lambda step: {"offer": F.col("price") * 10 + F.col("id") + step}, apply=lambda: F.col("value"), activate=lambda: F.lit(False),
                  around=lambda: {"dearest_price": F.max("price")}, to=lambda: F.when(F.col("price") >= 2, F.when(F.col("price") == F.col("dearest_price"), F.lit(3)).otherwise(F.when(F.col("price") == 2, F.lit(77)).otherwise(F.col("dst")))))
    program = HyperProgram(vertex=buyers, edge=none, reduce=F.max)
    for sparse in (0.0, 9.0):
        found = run(g, program, sparse=sparse)
        assert found.converged
        assert by_id(found.hyperedges, "dearest", "n") == {0: (50, 1), 1: (None, 0), 2: (None, 0), 3: (91, 2)}
    wrong = Side(initial=lambda: {"a": F.lit(1)}, state="b long", message=lambda _: F.col("a"), apply=lambda: {}, activate=lambda: F.lit(False))
    with pytest.raises(ValueError):
        run(g, HyperProgram(vertex=wrong, edge=none, reduce=F.max))


def test_python_reduction_before_and_after_the_exchange(spark):
    """Each task sends a row for each receiver at most, also of one that everything goes to."""
    rows = spark.range(30_000).select(F.lit(0).alias("e"), F.col("id").alias("v")).unionByName(spark.range(2000).select((F.col("id") % 7 + 1).alias("e"), F.col("id").alias("v")))
    g = from_table(rows, "e", "v")
    inc = g.v2e.withColumnsRenamed({"v": "src", "e": "dst"})
    vertex = catalogue.LARGEST_MEMBERS.vertex
    with fixed_plans(spark):
        state = initial_state(g.vertices, inc, vertex)
        sent = messages(state, Incidence(inc), vertex)
        inbox, _ = gather(sent, catalogue.LARGEST_MEMBERS, catalogue.LARGEST_MEMBERS.edge)
        inbox.collect()
        moved, todo = [], [inbox._jdf.queryExecution().executedPlan()]
        inbox._jdf.queryExecution().toRdd().count()
        while todo:
            node = todo.pop()
            if node.nodeName() == "Exchange":
                moved.append(node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.children().apply(k) for k in range(node.children().length())]
    got = {r["dst"]: [(x["degree"], x["id"]) for x in r["inbox"]] for r in inbox.collect()}
    assert got[0] == [(2, 0), (2, 1), (2, 2)] and got[1] == [(2, 0), (2, 7), (2, 14)] and len(got) == 8
    assert sorted(moved)[:2] != [] and min(m for m in moved if m) <= 8 * 4 * 2


def test_python_reduction_is_associative():
    table = pa.table({"dst": pa.array([1, 1, 2, 1, 1]), "message": pa.array([[{"degree": d, "id": k}] for k, d in enumerate([5, 5, 1, 9, 1])], pa.list_(pa.struct([("degree", pa.int64()), ("id", pa.int64())])))})
    whole = catalogue.largest_three(table)
    parts = pa.concat_tables([catalogue.largest_three(table.slice(0, 2)), catalogue.largest_three(table.slice(2))])
    assert whole.to_pylist() == catalogue.largest_three(parts).to_pylist()
    assert [[x["id"] for x in r["message"]] for r in whole.to_pylist()] == [[3, 0, 1], [2]]


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "Exchange" in line and "hashpartitioning(" in line]


def test_stored_buckets_are_not_exchanged_again(spark):
    g = chain(spark, 4, 3)
    stored = g.save_bucketed("chain_of_test", 3, mode="overwrite")
    inc = stored.v2e.withColumnsRenamed({"v": "src", "e": "dst"})
    with fixed_plans(spark, 3):
        state = initial_state(stored.vertices.repartition(3, "id"), inc, shortest_path_program(0).vertex)
        assert not [x for x in exchanges(state) if "src" in x or "v#" in x]
        kept = Incidence.of(inc, state, 60, 3, 1_000_000, stored=True)
        assert exchanges(kept.dealt) == []
        joined = messages(state.filter("active"), kept, shortest_path_program(0).vertex)
        assert len(exchanges(joined)) == 1  # that of the elements
        kept.release()
    found = run(stored, shortest_path_program(0), VERTEX)
    assert by_id(found.vertices, "value") == {k: (k,) for k in range(5)} | {14 + k: (None,) for k in range(3)}
    for part in ("vertices", "hyperedges", "v2e", "e2v"):
        spark.sql(f"DROP TABLE chain_of_test_{part}")


def test_text_is_scanned_twice(spark, tmp_path):
    g = chain(spark, 12)
    path = f"file://{tmp_path}/text"
    adjacency_text.write_adjacency(g, path)
    numbered = adjacency_text.numbered_lines(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert numbered.count("text") and numbered.count("Relation [") + numbered.count("Relation[") == 2
    back = adjacency_text.read_adjacency(spark, path)
    for table in (back.v2e, back.e2v, back.vertices, back.hyperedges):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "FileScan text" not in plan
    assert "PushedFilters: [IsNotNull(line), GreaterThanOrEqual(line" in back.v2e._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, back.v2e.collect())) == sorted(map(tuple, g.v2e.collect()))
