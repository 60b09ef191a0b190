"""Nearest neighbours by inner product with vantage-point trees, one per shard of the vectors.

Inner products become distances by one more component: with M the largest norm,
x goes to (x, sqrt(M^2 - |x|^2)) and a query q to (q, 0), and the squared distance
is |q|^2 + M^2 - 2 q.x. So the triangle inequality holds, and the nearest vector
is the one with the largest inner product.

Rows are dealt to cells around a bounded sample of pivots, and a cell to as many
shards as its rows need; each shard gets a tree, written as one row. A query is
first searched in one shard of its own cell. What it finds there, the distance to
beat, goes with it to all other shards whose cell can hold something nearer.
Trees and queries of a shard meet in a sorted stream, the tree first, so a task
holds one tree and one batch of queries at a time.

Pruning multiplies each bound by ``factor``: with 1 nothing nearer is ever
skipped, so the result is exact; larger factors skip more and may miss some.

Inner products are computed by matrix products first, and those that come within
their rounding error of the distance to beat are summed again in double
precision, component after component; only that sum is compared and returned.

Defined cases: null, empty and zero vectors and those with null or non-finite
components, or with a squared norm that is not finite, take no part; nor do
vectors of another length than most have. Every row is a candidate of its own,
also where several have one id; a row is never its own neighbour. Null ids come
after all others among equal scores. Fewer candidates than asked for are all
returned. An empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knitwork.llm.common import stored
from knitwork.llm.vector_codes import finite, usual_length

#: Pivots at most (a fixed number is broadcast), bytes of a shard's vectors, rows of a leaf, and queries of a shard that one task takes, about.
MOST_PIVOTS, SHARD_BYTES, LEAF, QUERIES_PER_TASK = 256, 8_000_000, 64, 4096
#: Candidates held before they are cut to the nearest ones, per query and neighbour asked for.
HELD = 4
#: Ids of rows without one: after all others.
_NO_ID = np.iinfo(np.int64).max


def _doubles(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class Tree:
    """Rows of a shard in an order that makes every leaf a range of them, and nodes: (row of the vantage point, inner child, outer child,
    least and largest distance of the inner rows, of the outer rows) or, for a leaf, (first row, end)."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray, most: float, leaf: int = LEAF) -> None:
        lift = np.sqrt(np.maximum(most - (vectors * vectors).sum(1), 0.0))
        order, self.nodes = np.argsort(keys, kind="stable"), []
        lifted = np.concatenate([vectors, lift[:, None]], axis=1)
        places: list[np.ndarray] = []

        def grow(rows: np.ndarray, begin: int) -> int:
            node = len(self.nodes)
            self.nodes.append(None)
            if len(rows) <= leaf:
                places.append(rows)
                self.nodes[node] = (begin, begin + len(rows))
                return node
            # far from the first row, so that rows spread out around it
            away = most * 2 - 2 * (lifted[rows] @ lifted[rows[0]])
            vantage = rows[int(away.argmax())]
            distance = np.sqrt(np.maximum(most * 2 - 2 * (lifted[rows] @ lifted[vantage]), 0.0))
            ranked, half = np.argsort(distance, kind="stable"), len(rows) // 2
            d, rows = distance[ranked], rows[ranked]
            inner, outer = grow(rows[:half], begin), grow(rows[half:], begin + half)
            self.nodes[node] = (vectors[vantage], inner, outer, d[0], d[half - 1], d[half], d[-1])
            return node

        if len(order):
            grow(order, 0)
        taken = np.concatenate(places) if places else order
        self.most, self.ids, self.keys, self.vectors = most, ids[taken], keys[taken], vectors[taken]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))


class Search:
    """The nearest rows of one tree to a batch of queries."""

    def __init__(self, tree: Tree, queries: np.ndarray, keys: np.ndarray, beat: np.ndarray, k: int, factor: float) -> None:
        self.tree, self.queries, self.keys, self.k, self.factor = tree, queries, keys, k, factor
        self.beat, self.visited = beat.copy(), 0
        norms = (queries * queries).sum(1)
        self.reach = norms + tree.most
        width = queries.shape[1]
        self.doubt = 4 * width * 2.3e-16 * np.sqrt(norms)  # times the norm of a row: rounding of an inner product
        self.slack = 4 * np.sqrt(width * 2.3e-16 * self.reach)  # rounding of distances and their differences
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def _cut(self) -> None:
        """Keep the nearest rows of each query; with all of them found, the last one is what others have to beat."""
        if not self.found:
            return
        q, row, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((self.tree.keys[row], self.tree.ids[row], -score, q))
        q, row, score = q[order], row[order], score[order]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        kept = rank < self.k
        last = rank == self.k - 1
        self.beat[q[last]] = np.maximum(self.beat[q[last]], score[last])
        self.found, self.held = [(q[kept], row[kept], score[kept])], int(kept.sum())

    def _scan(self, begin: int, end: int, rows: np.ndarray) -> None:
        tree = self.tree
        self.visited += len(rows) * (end - begin)
        near = self.queries[rows] @ tree.vectors[begin:end].T
        q, x = np.nonzero(near >= self.beat[rows, None] - self.doubt[rows, None] * tree.norms[begin:end])
        q, x = rows[q], x + begin
        other = tree.keys[x] != self.keys[q]
        q, x = q[other], x[other]
        for at in range(0, len(q), 65_536):
            a, b = q[at : at + 65_536], x[at : at + 65_536]
            score = np.cumsum(self.queries[a] * tree.vectors[b], axis=1)[:, -1]
            fine = score >= self.beat[a]
            self.found.append((a[fine], b[fine], score[fine]))
            self.held += int(fine.sum())
        if self.held > HELD * self.k * len(self.queries):
            self._cut()

    def _descend(self, node: int, rows: np.ndarray, home: np.ndarray) -> None:
        if not rows.size:
            return
        entry = self.tree.nodes[node]
        if len(entry) == 2:
            home[rows] = node
            self._scan(*entry, rows)
            return
        vantage, inner, outer, _, last_in, first_out, _ = entry
        nearer = self._distance(rows, vantage) < (last_in + first_out) / 2
        self._descend(inner, rows[nearer], home)
        self._descend(outer, rows[~nearer], home)

    def _distance(self, rows: np.ndarray, vantage: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.reach[rows] - 2 * (self.queries[rows] @ vantage), 0.0))

    def _sweep(self, node: int, rows: np.ndarray, home: np.ndarray) -> None:
        entry = self.tree.nodes[node]
        if len(entry) == 2:
            if (rows := rows[home[rows] != node]).size:
                self._scan(*entry, rows)
            return
        vantage, inner, outer, *ranges = entry
        distance = self._distance(rows, vantage)
        for child, low, high in ((inner, *ranges[:2]), (outer, *ranges[2:])):
            bound = np.maximum(np.maximum(low - distance, distance - high), 0.0)
            open_ = may_hold_nearer(bound, self.reach[rows], self.beat[rows], self.slack[rows], self.factor)
            if open_.any():
                self._sweep(child, rows[open_], home)

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row of the tree, score): at most k for each query, the nearest first."""
        if len(self.queries) and self.tree.nodes:
            home = np.zeros(len(self.queries), np.int64)
            self._descend(0, np.arange(len(self.queries)), home)
            self._cut()
            self._sweep(0, np.arange(len(self.queries)), home)
            self._cut()
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return self.found[0] if self.found else none


def may_hold_nearer(bound: np.ndarray, reach: np.ndarray, beat: np.ndarray, slack: np.ndarray, factor: float) -> np.ndarray:
    """Whether what is at least ``bound`` away may be as near as the inner product to beat; ``reach`` is |q|^2 + M^2."""
    radius = np.sqrt(np.maximum(reach - 2 * np.maximum(beat, -reach), 0.0))
    return factor * np.maximum(bound - slack, 0.0) <= radius + slack


@dataclass(frozen=True)
class Index:
    """Tables of an index: rows (key, vec_id, vector, cell, shard) and trees (shard, cell, tree); per cell its pivot, the nearest and the
    farthest row from it, its first shard and how many it has. ``most`` is the largest squared norm."""

    rows: DataFrame
    trees: DataFrame
    pivots: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    first_shard: np.ndarray
    shards: np.ndarray
    most: float
    width: int


def _pivots(rows: DataFrame, total: int, cells: int, width: int) -> np.ndarray:
    """Different vectors chosen by hash, ``cells`` at most."""
    some = rows if total <= 64 * cells else rows.filter(F.pmod(F.xxhash64("vector"), F.lit(total)) < 16 * cells)
    taken = some.select("vector", F.xxhash64("vector").alias("h")).dropDuplicates(["h"]).orderBy("h").limit(cells).collect()
    return np.array([r["vector"] for r in taken], np.float64).reshape(-1, width)


def _lift(vectors: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most - (vectors * vectors).sum(1), 0.0))


def _pivot_distances(vectors: np.ndarray, lift: np.ndarray | None, pivots: np.ndarray, most: float) -> np.ndarray:
    """Distances of lifted vectors, or of queries (no lift), to lifted pivots."""
    inner, own = vectors @ pivots.T, most
    if lift is None:
        own = (vectors * vectors).sum(1)[:, None]
    else:
        inner = inner + lift[:, None] * _lift(pivots, most)
    return np.sqrt(np.maximum(own + most - 2 * inner, 0.0))


def build(vectors: DataFrame, vector: str = "embedding", most_pivots: int = MOST_PIVOTS, shard_bytes: int = SHARD_BYTES, leaf: int = LEAF) -> Index | None:
    """Every row that takes part, in shards with a tree each, all written; None if there is none."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[vector]
    values = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("vector")).filter(finite("vector"))
    width = usual_length(slim, "vector")
    slim = slim.filter(F.size("vector") == width).withColumn("norm", norm).filter((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    # numbered as they are read and written at once: the same wherever the written table is read
    rows = stored(slim.select(F.monotonically_increasing_id().alias("key"), "vec_id", "vector", "norm"), "vectors")
    total, most = rows.agg(F.count("*"), F.max("norm")).collect()[0]
    if not total:
        return None
    most *= 1 + 1e-12
    # shards as large as memory allows, but enough of them for all tasks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    shard_rows = min(max(256, shard_bytes // (8 * width)), max(256, -(-total // (4 * tasks))))
    pivots = _pivots(rows, total, max(1, min(most_pivots, total // (2 * shard_rows))), width)
    sent = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _doubles(batch.column("vector"), width)
            distance = _pivot_distances(own, _lift(own, most), sent.value, most)
            cell = distance.argmin(1)
            extra = [pa.array(cell.astype(np.int32)), pa.array(distance[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "vec_id", "vector")), *extra], names=["key", "vec_id", "vector", "cell", "away"])

    vector_type = dict(rows.dtypes)["vector"]
    placed = stored(rows.drop("norm").mapInArrow(place, f"key long, vec_id long, vector {vector_type}, cell int, away double"), "placed-vectors")
    nearest, farthest, shards = np.zeros(len(pivots)), np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("cell").agg(F.min("away"), F.max("away"), F.count("*")).collect():
        nearest[r[0]], farthest[r[0]], shards[r[0]] = r[1], r[2], -(-r[3] // shard_rows)
    first_shard = np.cumsum(shards) - shards
    share = F.pmod(F.xxhash64("key"), F.element_at(F.lit(shards.tolist()), F.col("cell") + 1))
    dealt = placed.drop("away").withColumn("shard", F.element_at(F.lit(first_shard.tolist()), F.col("cell") + 1) + share)

    def grow(table: pa.Table) -> pa.Table:
        own = _doubles(table.column("vector").combine_chunks(), width)
        ids = np.array([_NO_ID if x is None else x for x in table.column("vec_id").to_pylist()], np.int64)
        tree = Tree(ids, table.column("key").to_numpy(), own, most, leaf)
        first = table.slice(0, 1)
        return pa.table({"shard": first.column("shard"), "cell": first.column("cell"), "tree": pa.array([pickle.dumps(tree, 5)], pa.binary())})

    trees = stored(dealt.groupBy("shard").applyInArrow(grow, "shard long, cell int, tree binary"), "vantage-trees")
    return Index(dealt, trees, pivots, nearest, farthest, first_shard, shards, most, width)


_FOUND = "query_key long, query_id long, key long, vec_id long, score double"


def _meet(index: Index, asked: DataFrame, shares: int, k: int, factor: float) -> DataFrame:
    """Searches queries (shard, share, query_key, query_id, vector, beat) in the trees of their shards."""
    width = index.width
    nothing = lambda kind: F.lit(None).cast(kind)
    trees = index.trees.select("shard", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), "tree")
    vector_type = dict(asked.dtypes)["vector"]
    trees = trees.select("*", *(nothing("long").alias(c) for c in ("query_key", "query_id")), nothing(vector_type).alias("vector"), nothing("double").alias("beat"))
    queries = asked.select("shard", "share", F.lit(1).alias("kind"), nothing("binary").alias("tree"), "query_key", "query_id", "vector", "beat")
    dealt = trees.unionByName(queries).repartition("shard", "share").sortWithinPartitions("shard", "share", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(kinds) | (kinds[1:] == 0)) + 1).tolist(), len(kinds)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    tree = pickle.loads(part.column("tree")[0].as_py())
                    continue
                key, name = part.column("query_key").to_numpy(), part.column("query_id")
                beat = part.column("beat").to_numpy()
                q, row, score = Search(tree, _doubles(part.column("vector"), width), key, beat, k, factor).run()
                ids = pa.array(tree.ids[row], mask=tree.ids[row] == _NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(key[q]), name.take(pa.array(q)), pa.array(tree.keys[row]), ids, pa.array(score)], names=["query_key", "query_id", "key", "vec_id", "score"])

    return dealt.mapInArrow(run, _FOUND)


def search(index: Index, queries: DataFrame, k: int = 20, factor: float = 1.0, queries_per_task: int = QUERIES_PER_TASK) -> DataFrame:
    """query_key, query_id, rank (from 1), key, vec_id and score of the ``k`` nearest rows found for each query.

    ``queries`` are rows of the index or others, with columns key (their own row's, or null), vec_id and vector.
    """
    if factor < 1:
        raise ValueError("factor must be at least 1, which is exact")
    spark = queries.sparkSession
    total = queries.count()
    shares = max(1, -(-total // queries_per_task))
    share = F.pmod(F.xxhash64("query_key", F.lit(7)), F.lit(shares)).cast("int").alias("share")
    sent = spark.sparkContext.broadcast((index.pivots, index.nearest, index.farthest, index.first_shard, index.shards))
    width, most, vector_type = index.width, index.most, dict(queries.dtypes)["vector"]
    columns = ["query_key", "query_id", "vector", "beat", "shard"]

    def home_of(key: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """One shard of the nearest cell."""
        _, _, _, first, shards = sent.value
        cell = np.where(shards > 0, distance, np.inf).argmin(1)
        return first[cell] + key % shards[cell]

    def route(batches: Iterator[pa.RecordBatch], elsewhere: bool) -> Iterator[pa.RecordBatch]:
        pivots, nearest, farthest, first, shards = sent.value
        cell_of = np.repeat(np.arange(len(shards)), shards)
        for batch in batches:
            own, key = _doubles(batch.column("vector"), width), batch.column("query_key").to_numpy()
            distance = _pivot_distances(own, None, pivots, most)
            home = home_of(key, distance)
            if not elsewhere:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns[:4]), pa.array(home)], names=columns)
                continue
            reach = (own * own).sum(1) + most
            bound = np.maximum(np.maximum(nearest - distance, distance - farthest), 0.0)
            slack = 4 * np.sqrt(width * 2.3e-16 * reach)
            beat = batch.column("beat").to_numpy()
            open_ = may_hold_nearer(bound, reach[:, None], beat[:, None], slack[:, None], factor)[:, cell_of]
            open_[np.arange(len(home)), home] = False
            for at in range(0, len(own), 64):  # a row per query and shard, some at a time
                q, shard = np.nonzero(open_[at : at + 64])
                some = batch.slice(at, 64).take(pa.array(q))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in columns[:4]), pa.array(shard)], names=columns)

    schema = f"query_key long, query_id long, vector {vector_type}, beat double, shard long"
    keyed = queries.select(F.coalesce("key", -1 - F.monotonically_increasing_id()).alias("query_key"), F.col("vec_id").alias("query_id"), "vector")
    keyed = stored(keyed, "queries")
    ask = lambda rows, elsewhere: rows.mapInArrow(lambda b: route(b, elsewhere), schema).withColumn("share", share)
    first = stored(_meet(index, ask(keyed.withColumn("beat", F.lit(float("-inf"))), False), shares, k, factor), "first-neighbours")
    beat = first.groupBy("query_key").agg(F.count("*").alias("n"), F.min("score").alias("last")).select("query_key", F.when(F.col("n") >= k, F.col("last")).alias("beat"))
    knowing = keyed.join(beat, "query_key", "left").withColumn("beat", F.coalesce("beat", F.lit(float("-inf"))))
    rest = _meet(index, ask(knowing.select("query_key", "query_id", "vector", "beat"), True), shares, k, factor)
    order = W.partitionBy("query_key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "key")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_key", "query_id", "rank", "key", "vec_id", "score")


def neighbours(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, factor: float = 1.0, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest other rows of every row whose id satisfies ``is_query``."""
    index = build(vectors, vector)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.rows.filter(F.coalesce(is_query(F.col("vec_id")), F.lit(False))).select("key", "vec_id", "vector")
    return search(index, queries, k, factor).select("query_id", "rank", "vec_id", "score")
