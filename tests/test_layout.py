"""Partition layouts: rows of small hypergraphs by hand, round trips, binary folders, commands, and hubs in the superstep loop."""

import os
import struct

import pytest
from pyspark.sql import functions as F
from test_hypergraph import F1, F2_E, F2_V, graph, values

from knitwork import __main__ as commands
from knitwork.functions.programs import components_program, connected_components, page_rank, run_algorithm, shortest_path
from knitwork.operators import layout
from knitwork.plans import catalogue
from knitwork.plans.supersteps import EDGE, VERTEX, run
from knitwork.sources import adjacency_text, placement_files, shared


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def same(a, b):
    for x, y in ((a.v2e, b.v2e), (a.e2v, b.e2v)):
        assert rows(x, "v", "e") == rows(y, "v", "e")
    for x, y in ((a.vertices, b.vertices), (a.hyperedges, b.hyperedges)):
        assert sorted(map(tuple, x.select("id", "weight").collect()), key=repr) == sorted(map(tuple, y.select("id", "weight").collect()), key=repr)


def test_layout_rows(spark):
    cut = layout.build(graph(spark, F1), 2)
    # masters are the smallest parts: v0 0, v1 0, v2 0 (copy in 1), v3 1, v4 0, v5 0 (copy in 1), v6 0
    assert rows(cut.replicas, "part", "old_id", "new_id", "total_degree", "neighbours") == sorted([
        (0, 0, 0, 1, [0]), (0, 1, 2, 1, [0]), (0, 2, 4, 2, [0]), (1, 2, 4, 2, [1]), (1, 3, 1, 1, [1]), (0, 4, 6, 1, [2]), (0, 5, 8, 2, [2]), (1, 5, 8, 2, [3]), (0, 6, 10, 0, []),
    ])
    assert rows(cut.uniques, "part", "id", "neighbours") == [(0, 0, [0, 2, 4]), (0, 2, [6, 8]), (1, 1, [1, 4]), (1, 3, [8])]
    assert rows(cut.masters, "part", "new_id", "servant_parts") == [(0, 4, [1]), (0, 8, [1])]
    assert cut.meta == {"uniques_as_hyperedges": True, "total_replica_elements": 7, "total_unique_elements": 4, "partitions": 2}


@pytest.mark.parametrize("side", [EDGE, VERTEX])
def test_round_trip(spark, tmp_path, side):
    for k, g in enumerate((graph(spark, F1), graph(spark, F2_V, F2_E, [5, 2, 7, 1]))):
        path = f"file://{tmp_path}/{side}{k}"
        layout.write(layout.build(g, 3, side, chunk=1), path)  # one neighbour a row, or nearly
        back = layout.to_hypergraph(layout.read(spark, path))
        same(g, back)
    assert values(shortest_path(back, 0).vertices) == [0, 5, 7, 14, None]


def test_faults(spark):
    g = graph(spark, F1)
    with pytest.raises(ValueError):
        layout.build(g, 0)
    with pytest.raises(ValueError):
        layout.build(g, 2, "node")
    with pytest.raises(Exception, match="no partition"):
        layout.build(g, 2, placed=spark.createDataFrame([(0, 1)], "id long, part short")).uniques.collect()


def test_weights_as_text(spark, tmp_path):
    cut = layout.build(graph(spark, F2_V, F2_E, [5, 2, 7, 1]), 2)
    layout.write_weights(cut, f"file://{tmp_path}/w")
    assert rows(layout.read_weights(spark, f"file://{tmp_path}/w/unique_weights"), "part", "id", "weight") == [(0, 0, "5"), (0, 2, "7"), (1, 1, "2"), (1, 3, "1")]


def test_binary_folders(spark, tmp_path):
    g = graph(spark, F2_V, F2_E, [5, 2, 7, 1])
    cut = layout.build(g, 2)
    number = lambda *xs: struct.pack(f">{len(xs)}I", *xs)
    for part in range(2):
        folder = tmp_path / f"partition-{part}"
        folder.mkdir()
        own = lambda df: df.filter(F.col("part") == part).collect()  # noqa: B023, E731
        (folder / "replicas.bin").write_bytes(b"".join(number(r["old_id"], r["new_id"], r["total_degree"], len(r["neighbours"]), *r["neighbours"]) for r in own(cut.replicas)))
        (folder / "uniques.bin").write_bytes(b"".join(number(r["id"], len(r["neighbours"]), *r["neighbours"]) for r in own(cut.uniques)))
        (folder / "master_partitions.bin").write_bytes(b"".join(number(r["new_id"]) + bytes([len(r["servant_parts"]), *r["servant_parts"]]) for r in own(cut.masters)))
        (folder / "unique_weighs.csv").write_text("".join(f"{r['id']}, {r['weight']}\n" for r in own(cut.uniques)))
        (folder / "meta.yaml").write_text("uniques_as_hyperedges: true\ntotal_replica_elements: 5\ntotal_unique_elements: 4\n")
    read = layout.read_binary(spark, f"file://{tmp_path}")
    assert read.meta == {"uniques_as_hyperedges": True, "total_replica_elements": 5, "total_unique_elements": 4}
    assert rows(read.masters, "part", "new_id", "servant_parts") == rows(cut.masters, "part", "new_id", "servant_parts")
    same(g, layout.to_hypergraph(read))
    for broken in (b"\0\0\0", number(1, 2, 3, 4)):
        with pytest.raises(ValueError):
            list(layout.replica_records(broken))
    with pytest.raises(ValueError):
        list(layout.unique_records(number(1, 9)))
    with pytest.raises(ValueError):
        list(layout.master_records(number(1) + bytes([3, 0])))
    (tmp_path / "partition-1" / "meta.yaml").write_text("other: 1\n")
    with pytest.raises(ValueError):
        layout.read_meta(spark, f"file://{tmp_path}")


def test_commands(spark, tmp_path):
    root = f"file://{tmp_path}"
    adjacency_text.write_adjacency(graph(spark, F2_V, F2_E, [5, 2, 7, 1]), f"{root}/text", weighted=True)
    placement_files.write_placement(spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "id long, part short"), f"{root}/places")
    cut = commands.main(["partition", f"{root}/text", "2", "-o", f"{root}/layout", "-p", f"{root}/places"], spark)
    assert rows(cut.uniques, "part", "id") == [(0, 1), (0, 3), (1, 0), (1, 2)]
    found = commands.main(["node", "shortest-path", f"{root}/layout", "-o", f"{root}/out", "--source", "3"], spark)
    assert values(found.vertices) == [14, 9, 7, 0, None]
    assert values(spark.read.parquet(f"{root}/out/vertices")) == [14, 9, 7, 0, None] and spark.read.parquet(f"{root}/out/trace").count() == found.supersteps
    with pytest.raises(SystemExit):
        commands.main(["node", "other", f"{root}/layout", "-o", f"{root}/x"], spark)


def test_hubs_are_spread(spark):
    for g in (graph(spark, F1), graph(spark, F2_V, F2_E, [5, 2, 7, 1])):
        for unique in (EDGE, VERTEX):
            want, got = (run(g, components_program(unique), unique, hub_incidences=h) for h in (10, 0))
            assert values(want.vertices) == values(got.vertices) and values(want.hyperedges) == values(got.hyperedges)


def test_loop_leaves_nothing_behind(spark):
    root = shared.shared_root(spark).removeprefix("file://")
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if "/rdd-" in d}
    before, cached = files(), len(spark.sparkContext._jsc.getPersistentRDDs())
    found = connected_components(graph(spark, F1))
    folders = {os.path.dirname(f) for f in files() - before}
    assert found.supersteps == 2 and len(folders) == 2  # one checkpoint of each side
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == cached


def test_rank_on_hyperedges(spark):
    found = page_rank(graph(spark, F1), 1, unique_side=VERTEX)
    assert values(found.hyperedges) == [2.5, 1.5, 1.5, 0.5] and values(found.vertices) == [0, 0, 0, 0, 0, 0, 1]
    assert values(run_algorithm("page-rank", graph(spark, F1), 1, unique_side=VERTEX).hyperedges) == [2.5, 1.5, 1.5, 0.5]


def test_program_sees_the_superstep(spark):
    assert values(run(graph(spark, F1), catalogue.FIRST_REACHED).vertices) == [0, 1, 1, 2, None, None, None]


def test_placement_files_round_trip(spark, tmp_path):
    given = spark.createDataFrame([(k, k % 3) for k in range(9)], "id long, part short")
    placement_files.write_placement(given, f"file://{tmp_path}/p")
    assert rows(placement_files.read_placement(spark, f"file://{tmp_path}/p"), "id", "part") == [(k, k % 3) for k in range(9)]
