"""Golden values of two small hypergraphs, invariants, file formats and placements."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from knitwork.functions.programs import connected_components, label_propagation, page_rank, run_algorithm, shortest_path
from knitwork.operators import placement
from knitwork.plans import catalogue
from knitwork.plans.supersteps import EDGE, VERTEX
from knitwork.sources import adjacency_text, placement_files
from knitwork.sources.hypergraph import Hypergraph, from_table, read
from knitwork.streaming import incidence

F1 = {0: [0], 1: [0], 2: [0, 1], 3: [1], 4: [2], 5: [2, 3], 6: []}
F2_V = {0: [0], 1: [0, 1], 2: [1, 2], 3: [2], 4: [3]}
F2_E = {0: [0, 1], 1: [1, 2], 2: [2, 3], 3: [4, 0]}


def graph(spark, v2e, e2v=None, lengths=None):
    n = len({e for es in v2e.values() for e in es})
    v = [(a, b) for a, bs in v2e.items() for b in bs]
    e = [(b, a) for a, b in v] if e2v is None else [(a, b) for a, bs in e2v.items() for b in bs]
    edges = [(k, None if lengths is None else str(lengths[k])) for k in range(n)]
    return Hypergraph(
        spark.createDataFrame([(k, None) for k in v2e], "id long, weight string"), spark.createDataFrame(edges, "id long, weight string"),
        spark.createDataFrame(v, "v long, e long"), spark.createDataFrame(e, "e long, v long"),
    )


def values(df):
    return [r["value"] if r["value"] is None else round(r["value"], 6) for r in df.orderBy("id").collect()]


def f1(spark):
    return graph(spark, F1)


def f2(spark):
    return graph(spark, F2_V, F2_E, [5, 2, 7, 1])


def test_degrees_and_dual(spark):
    g = f1(spark).checked()
    assert [r["degree"] for r in g.vertex_degree().orderBy("id").collect()] == [1, 1, 2, 1, 1, 2, 0]
    assert [r["degree"] for r in g.hyperedge_degree().orderBy("id").collect()] == [3, 2, 2, 1]
    back = g.dual().dual()
    assert sorted(map(tuple, back.v2e.collect())) == sorted(map(tuple, g.v2e.collect()))
    with pytest.raises(ValueError):
        Hypergraph(g.vertices.filter("id > 0"), g.hyperedges, g.v2e, g.e2v).checked()


def test_page_rank(spark):
    one = page_rank(f1(spark), 1)
    assert values(one.vertices) == [0.833333, 0.833333, 1.583333, 0.75, 0.75, 1.25, 1.0]
    assert values(one.hyperedges) == [0, 0, 0, 0]
    assert values(page_rank(f1(spark), 2).vertices) == [0.821528, 0.821528, 1.589236, 0.767708, 0.696875, 1.303125, 1.0]
    assert abs(sum(values(page_rank(f1(spark), 4).vertices)) - 7) < 1e-5
    with pytest.raises(ValueError):
        run_algorithm("page-rank", f1(spark))


def test_page_rank_compat(spark):
    found = run_algorithm("page-rank", f1(spark), 1, compat=True)
    assert values(found.vertices) == [0.333333, 0.333333, 0.833333, 0.5, 0.5, 1.5, 0.0]


def test_components(spark):
    found = connected_components(f1(spark))
    assert (values(found.vertices), values(found.hyperedges)) == ([1, 1, 1, 1, 3, 3, None], [1, 1, 3, 3])
    assert found.converged and found.supersteps == 2
    other = connected_components(f1(spark), unique_side=VERTEX)
    assert (values(other.vertices), values(other.hyperedges)) == ([3, 3, 3, 3, 5, 5, 6], [3, 3, 5, 5])
    assert values(connected_components(f2(spark)).vertices) == [3, 3, 3, 3, 3]
    assert values(connected_components(f2(spark), unique_side=VERTEX).vertices) == [4, 4, 4, 4, 4]


def test_shortest_paths(spark):
    found = shortest_path(f1(spark), 0)
    assert (values(found.vertices), values(found.hyperedges)) == ([0, 1, 1, 2, None, None, None], [0, 1, None, None])
    assert found.supersteps == 3
    heavy = shortest_path(f2(spark), 0)
    assert (values(heavy.vertices), values(heavy.hyperedges)) == ([0, 5, 7, 14, None], [0, 5, 7, None])
    assert values(shortest_path(f2(spark), 3).vertices) == [14, 9, 7, 0, None]
    compat = run_algorithm("shortest-path", f1(spark), source=0, compat=True)
    assert values(compat.vertices) == [0, 0, 0, 1, None, None, None] and values(compat.hyperedges) == [0, 1, None, None]
    assert values(shortest_path(f1(spark), 0, limit=0).vertices) == [0, None, None, None, None, None, None]


def test_labels(spark):
    found = label_propagation(f1(spark), 2)
    assert values(found.vertices) == [0, 0, 0, 0, 4, 4, None] and values(found.hyperedges) == [None] * 4
    assert values(label_propagation(f2(spark), 3).vertices) == [0, 0, 0, 0, 4]
    with pytest.raises(ValueError):
        label_propagation(f1(spark), 1, unique_side=VERTEX, strict=True)


def test_duplicate_incidence_counts_twice(spark):
    g = from_table(spark.createDataFrame([(0, 0), (0, 0), (0, 1)], "e long, v long"), "e", "v")
    assert [r["degree"] for r in g.vertex_degree().orderBy("id").collect()] == [2, 1]
    assert abs(sum(values(page_rank(g, 2).vertices)) - 2) < 1e-6


def test_trace(spark):
    rows = connected_components(f1(spark), trace=True).trace.orderBy("superstep").collect()
    assert tuple(rows[0]) == (0, 7, 7, 4, 4)


def test_text_round_trip(spark, tmp_path):
    g = f2(spark)
    path = f"file://{tmp_path}/graph"
    for weighted in (False, True):
        adjacency_text.write_adjacency(g, path, weighted, parts=2)
        back = adjacency_text.read_adjacency(spark, path)
        assert sorted(map(tuple, back.v2e.collect())) == sorted(map(tuple, g.v2e.collect()))
        assert sorted(map(tuple, back.e2v.collect())) == sorted(map(tuple, g.e2v.collect()))
        assert [r["weight"] for r in back.hyperedges.orderBy("id").collect()] == (["5", "2", "7", "1"] if weighted else [None] * 4)


def test_text_weights_last_wins_and_faults(spark, tmp_path):
    (tmp_path / "w").write_text("\n".join(map(str, ["WeightedAdjacencyHypergraph", 2, 2, 1, 2, 0, 1, 0, 0, 7, 9, 0, 0, 1, 4, 6])))
    g = adjacency_text.read_adjacency(spark, f"file://{tmp_path}/w")
    assert [r["weight"] for r in g.hyperedges.collect()] == ["9"]
    assert [r["weight"] for r in g.vertices.orderBy("id").collect()] == ["4", "6"]
    (tmp_path / "bad").write_text("Graph\n1\n1\n1\n1\n0\n0\n0\n0")
    with pytest.raises(ValueError):
        adjacency_text.read_adjacency(spark, f"file://{tmp_path}/bad")
    (tmp_path / "x").write_text("AdjacencyHypergraph\n1\n1\n1\n1\n0\n-3\n0\n0")
    with pytest.raises(Exception, match="unsigned"):
        adjacency_text.read_adjacency(spark, f"file://{tmp_path}/x").v2e.collect()
    assert adjacency_text.read_adjacency(spark, f"file://{tmp_path}/x", strict=False).v2e.collect()[0]["e"] is None


def test_parquet_round_trip(spark, tmp_path):
    f2(spark).write(f"file://{tmp_path}/pq")
    assert read(spark, f"file://{tmp_path}/pq").v2e.count() == 7


def test_placements(spark, tmp_path):
    for name, ids in (("partition-0", [0, 2]), ("partition-1.txt", [1, 3])):
        (tmp_path / name).write_text("\n".join(map(str, ids)))
    given = placement_files.read_placement(spark, f"file://{tmp_path}")
    g = f1(spark)
    placed = placement.by_table(g.hyperedges, given)
    assert [r["part"] for r in placed.orderBy("id").collect()] == [0, 1, 0, 1]
    inc = g.v2e.select(F.col("v").alias("src"), F.col("e").alias("dst"))
    held = placement.copies(g.vertices, inc, placed, 2)
    assert sorted(map(tuple, held.collect())) == [(0, 0, 1), (1, 0, 1), (2, 0, 1), (2, 1, 1), (3, 1, 1), (4, 0, 1), (5, 0, 1), (5, 1, 1), (6, 0, 0)]
    ids = {r["id"]: r["new_id"] for r in placement.new_ids(held, 2).collect()}
    assert ids == {0: 0, 1: 2, 2: 4, 3: 1, 4: 6, 5: 8, 6: 10}
    with pytest.raises(Exception, match="no partition"):
        placement.by_table(spark.range(9), given).collect()


def test_stream_of_incidences(spark, tmp_path):
    spark.createDataFrame([(1, 5), (1, 6), (2, 5), (None, 5)], "a long, b long").write.parquet(f"file://{tmp_path}/in")
    stream = incidence.incidence_stream(spark, f"file://{tmp_path}/in", "a long, b long", "a", "b")
    query = incidence.degrees(stream).writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("degrees").collect())) == [(5, 2), (6, 1)]


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["page_rank_k3", "cc_fixpoint", "lp_k3", "new_ids", "csr_roundtrip", "active_trace_sssp"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    expected = con.sql(catalogue.oracle_sql()[name])
    df = catalogue.queries()[name](spark, SF).select(*expected.columns)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected.fetchall(), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["cc_hyperedges", "cc_k2", "cc_dual", "sssp_weighted", "sssp_limit", "sssp_unreachable", "custom_program"])
def test_whole_tables_against_sql(spark, name):
    test_against_sql(spark, name)
    con = duckdb.connect()
    side = "l_orderkey" if name == "cc_hyperedges" else "l_partkey"
    n = con.sql(f"SELECT count(DISTINCT {side}) FROM '{SF}/lineitem.parquet'").fetchall()[0][0]
    if name != "sssp_unreachable":
        assert catalogue.queries()[name](spark, SF).count() == n


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_long_paths_against_loops(spark):
    """Components and weighted paths of a sparse fixture with many supersteps, against plain loops."""
    items = duckdb.sql(f"SELECT l_orderkey, l_partkey, l_quantity FROM '{SF}/lineitem.parquet' WHERE l_quantity >= 40").fetchall()
    held, near, length = {}, {}, {}
    for e, v, q in items:
        held.setdefault(e, set()).add(v)
        near.setdefault(v, set()).add(e)
        length[e] = 1 + int(q) % 5
    rows = spark.createDataFrame([(e, v) for e, v, _ in items], "e long, v long")
    edges = spark.createDataFrame([(e, str(n)) for e, n in length.items()], "id long, weight string")
    g = from_table(rows, "e", "v", hyperedges=edges)

    label, far, source = {v: max(es) for v, es in near.items()}, {}, min(near)
    far[source], changed = 0, True
    while changed:
        changed = False
        for e, vs in held.items():
            top = max(e, *(label[v] for v in vs))
            cost = min((far[v] for v in vs if v in far), default=None)
            for v in vs:
                if label[v] < top:
                    label[v], changed = top, True
                if cost is not None and far.get(v, cost + length[e] + 1) > cost + length[e]:
                    far[v], changed = cost + length[e], True
    assert {r["id"]: r["value"] for r in connected_components(g).vertices.collect()} == label
    assert {r["id"]: r["value"] for r in shortest_path(g, source).vertices.collect()} == {v: far.get(v) for v in near}


def test_unknown_names(spark):
    with pytest.raises(ValueError):
        run_algorithm("other", f1(spark))
    assert EDGE != VERTEX
