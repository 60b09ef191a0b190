"""Lists of layouts come from sorted rows, and partitions are written by several tasks."""

from pyspark.sql import functions as F

from knitwork.operators import layout
from knitwork.sources import hypergraph
from knitwork.sources.hypergraph import Hypergraph, from_table


def test_partitions_are_written_by_several_tasks(spark, tmp_path):
    """Of two partitions each is written in as many files as there are tasks for it, and read back whole."""
    g = from_table(spark.range(4000).select((F.col("id") % 1000).alias("e"), (F.col("id") * 7 % 900).alias("v")), "e", "v")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        layout.write(layout.build(g, 2), f"file://{tmp_path}/cut", "overwrite")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    files = [p for k in range(2) for p in (tmp_path / "cut" / "uniques" / f"part={k}").glob("*.parquet")]
    assert len(files) > 2
    back = layout.to_hypergraph(layout.read(spark, f"file://{tmp_path}/cut"))
    assert sorted(map(tuple, back.v2e.collect())) == sorted(map(tuple, g.v2e.collect())) and sorted(map(tuple, back.e2v.collect())) == sorted(map(tuple, g.e2v.collect()))


def test_lists_of_any_length_come_from_sorted_rows(spark):
    """Lists over several batches of Arrow, in one row or in chunks by hash."""
    rows = spark.range(30_000).select(F.when(F.col("id") < 25_000, 5).otherwise(F.col("id") % 40 + 6).cast("long").alias("id"), (F.col("id") * 7919 % 30_011).alias("to"))
    want = {r["id"]: r["l"] for r in rows.groupBy("id").agg(F.sort_array(F.collect_list("to")).alias("l")).collect()}
    sizes = rows.groupBy("id").agg(F.count("*").alias("n"))
    whole = layout._lists(rows, sizes, ["id"], 65_536).collect()
    assert {r["id"]: r["neighbours"] for r in whole} == want and len(whole) == len(want)
    cut = layout._lists(rows, sizes, ["id"], 1000).collect()
    assert max(len(r["neighbours"]) for r in cut) < 1300 and len([r for r in cut if r["id"] == 5]) == 25
    assert {k: sorted(x for r in cut if r["id"] == k for x in r["neighbours"]) for k in want} == want


def test_lists_of_ends_are_dealt_once_and_written_as_they_lie(spark, tmp_path):
    """layout_meta: no list is exchanged or joined with copies or uniques again, and all rows are those of the way by element tables."""
    g = from_table(spark.range(3000).select((F.col("id") % 500 * 3).alias("e"), F.when(F.col("id") < 900, 7).otherwise(F.col("id") * 11 % 400).alias("v")), "e", "v")
    plain = Hypergraph(g.vertices, g.hyperedges, g.v2e, g.e2v, mirrored=True)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for side in ("hyperedge", "hypervertex"):
            cut, want = layout.build(g, 3, side, chunk=200), layout.build(plain, 3, side, chunk=200)
            plan = cut.uniques._jdf.queryExecution().executedPlan().toString()
            assert cut.dealt and not want.dealt and cut.meta == want.meta
            assert "Exchange" not in plan[: plan.index("ObjectHashAggregate")] and "Join" not in plan[: plan.index("ObjectHashAggregate")]
            for name in ("replicas", "uniques", "masters"):
                found, other = getattr(cut, name), getattr(want, name)
                assert found.columns == other.columns and sorted(map(str, found.collect())) == sorted(map(str, other.collect()))
            layout.write(cut, f"file://{tmp_path}/{side}")
            back = layout.read(spark, f"file://{tmp_path}/{side}")
            assert sorted(map(str, back.uniques.select(*cut.uniques.columns).collect())) == sorted(map(str, cut.uniques.collect())) and back.meta == cut.meta
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_frequent_keys_are_counted_exactly(spark, monkeypatch):
    """Whatever shares a counter with them, and however many counters are high."""
    rows = spark.range(1000).select(F.when(F.col("id") < 300, F.col("id") % 2).otherwise(F.col("id")).alias("k"))
    for counters, few in ((65_536, 256), (2, 256), (2, 0)):
        monkeypatch.setattr(hypergraph, "COUNTERS", counters)
        monkeypatch.setattr(hypergraph, "FEW_SLOTS", few)
        assert sorted(map(tuple, hypergraph.frequent(rows, ["k"], 100).collect())) == [(0, 150), (1, 150)]
        assert hypergraph.frequent(rows, ["k"], 1000).collect() == []
