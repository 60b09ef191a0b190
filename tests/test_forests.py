"""Components by forests, and paths by buckets, against plain loops."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from knitwork.functions.programs import shortest_path, shortest_path_program
from knitwork.operators import forests
from knitwork.plans.supersteps import VERTEX, run
from knitwork.sources.hypergraph import Hypergraph, from_table
from knitwork.sources.shared import release, scratch, written


def plain(links):
    """node -> largest connected node."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        up[low] = high
    return {x: top(x) for x in list(up)}


def labels(spark, links, **kwargs):
    found, rounds = forests.components(spark.createDataFrame(links, "a long, b long"), **kwargs)
    rows = [(r["node"], r["label"]) for r in found.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows), rounds


@pytest.mark.parametrize("together", [1_000_000, 40])
def test_components(spark, together):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, 999) for k in range(60)] + [(1000, 1001), (1001, 1000), (7, 7), (-5, -9)]
    got, _ = labels(spark, links, together=together, held=30)
    assert got == {x: y for x, y in plain([p for p in links if p[0] != p[1]]).items()}
    assert labels(spark, [(3, 3)], together=together) == ({}, 0)


def test_long_chain_in_few_rounds(spark):
    """100,000 nodes in a row, in order and shuffled: passes over the links, not steps along the chain."""
    rng = np.random.default_rng(1)
    for order in (np.arange(100_000), rng.permutation(100_000)):
        at = spark.createDataFrame(pd.DataFrame({"a": order[:-1], "b": order[1:]}))
        found, rounds = forests.components(at, together=2_000)
        assert rounds <= 20
        assert [tuple(r) for r in found.groupBy("label").count().collect()] == [(99_999, 100_000)]


def test_forest_of_arrays():
    rng = np.random.default_rng(3)
    for n in (1, 5, 300):
        a, b = rng.integers(0, n, n), rng.integers(0, n, n)
        node, root = forests.forest(a, b)
        want = plain(list(zip(a.tolist(), b.tolist(), strict=True)))
        assert dict(zip(node.tolist(), root.tolist(), strict=True)) == want


def test_isolated_elements(spark):
    elements = lambda ids: spark.createDataFrame([(k, None) for k in ids], "id long, weight string")
    g = Hypergraph(elements([0, 1, 2, 9]), elements([0, 4, 5]), spark.createDataFrame([(0, 4), (1, 4)], "v long, e long"), spark.createDataFrame([(4, 2)], "e long, v long"))
    found = forests.connected(g)
    assert {r["id"]: r["value"] for r in found.vertices.collect()} == {0: 4, 1: 4, 2: 4, 9: None}
    assert {r["id"]: r["value"] for r in found.hyperedges.collect()} == {0: 0, 4: 4, 5: 5}


def test_paths_by_buckets_send_less(spark):
    """Short ways of many steps beat long ones of few: without buckets the long ones are told first and told again."""
    rng = random.Random(2)
    rows = [(e, v) for e in range(30) for v in (e, e + 1)] + [(100 + k, v) for k in range(40) for v in rng.sample(range(31), 2)]
    length = {e: 1 if e < 100 else 3 * abs(a - b) + 2 for e in {e for e, _ in rows} for a, b in [[v for x, v in rows if x == e]]}
    edges = spark.createDataFrame([(e, str(n)) for e, n in length.items()], "id long, weight string")
    g = from_table(spark.createDataFrame(rows, "e long, v long"), "e", "v", hyperedges=edges)
    plainly, bucketed = (run(g, shortest_path_program(0, delta), VERTEX, count_messages=True, sparse=0.05) for delta in (None, 4))
    want = {k: (k,) for k in range(31)}
    for found in (plainly, bucketed):
        assert found.converged and {r["id"]: (r["value"],) for r in found.vertices.collect()} == want
        assert len(found.messages) == found.supersteps
    assert sum(bucketed.messages) < sum(plainly.messages)


def test_paths_by_buckets_in_full_states(spark):
    rows = [(0, 0), (0, 1), (1, 1), (1, 2), (2, 0), (2, 2), (3, 7), (3, 8)]
    edges = spark.createDataFrame([(0, "2"), (1, "2"), (2, "9"), (3, "1")], "id long, weight string")
    g = from_table(spark.createDataFrame(rows, "e long, v long"), "e", "v", hyperedges=edges)
    for limit in (None, 2):
        found = shortest_path(g, 0, delta=3, limit=limit)
        got = {r["id"]: r["value"] for r in found.vertices.collect()}
        assert got == ({0: 0, 1: 2, 2: 4, 7: None, 8: None} if limit is None else {0: 0, 1: 2, 2: None, 7: None, 8: None})


def test_scratch_is_deleted(spark):
    table = written(spark.range(3).select(F.col("id")), "test")
    assert table.count() == 3 and scratch(spark, "test") != scratch(spark, "test")
    release(spark)
    with pytest.raises(Exception, match="(?i)exist|not found|FileNotFound"):
        table.collect()
