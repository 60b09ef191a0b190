"""Vector code compression: vectors cut into parts, each part named by the nearest entry of its codebook.

Components become integers, so distances and sums are exact and do not depend on
how rows are dealt. In every round a kd-tree per codebook is broadcast (its size
is set by the parameters, not by the input); tasks find the nearest entry of
every part and add up integer sums and counts per entry, which are combined
before the exchange and summed across tasks. The driver gets one row per entry
and piece of 16 positions, and makes the next codebooks from them.

The search in a kd-tree first goes down to the leaf of a part, which gives it a
distance to beat, and then visits all boxes whose bound is not larger than the
distance so far. Boxes with an equal bound are visited too, so that an entry with
a lower index and the same distance is found.

Defined cases: null and empty vectors and those with null or non-finite
components are dropped; so are vectors of another length than most have, and
vectors with a component so large that squared distances would not fit 64 bits
(beyond 65,000 for 4 parts of 64 components). A length that the number of parts
does not divide gives the first parts one component more. Null ids come last in
the order of ids; an id in several rows gives its smallest vector to the first
codebook; every row gets a code of its own; null labels are one label. With
fewer vectors than entries the codebooks are smaller. An empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knitwork.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries in a leaf, and positions of an entry that are summed in one row.
LEAF, PIECE = 8, 16
#: Sums of integers up to this are exact in doubles.
_EXACT = 1 << 52


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact integers, (points, entries): by a matrix product in doubles where all sums fit, else component by component."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * points.shape[1] < _EXACT:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(1)[:, None] + (e * e).sum(1) - 2.0 * (p @ e.T)).astype(np.int64)
    out = np.zeros((len(points), len(entries)), np.int64)
    for k in range(points.shape[1]):
        out += (points[:, k, None] - entries[None, :, k]) ** 2
    return out


class KdTree:
    """A codebook (entries, components) of integers as a tree of boxes. Arrays by node: lower and upper corner, the component and value
    it is cut at, its children, or the entries of a leaf in ascending order."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF) -> None:
        self.entries = np.asarray(entries, np.int64)
        self.low, self.high, self.cut, self.children, self.leaves = [], [], [], [], []
        self._grow(np.arange(len(self.entries)), leaf)

    def _grow(self, members: np.ndarray, leaf: int) -> int:
        own, node = self.entries[members], len(self.low)
        low, high = own.min(0), own.max(0)
        self.low.append(low)
        self.high.append(high)
        for x in (self.cut, self.children, self.leaves):
            x.append(None)
        axis = int(np.argmax(high - low))
        if len(members) <= leaf or high[axis] == low[axis]:
            self.leaves[node] = np.sort(members)
            return node
        value = np.sort(own[:, axis])[len(members) // 2]
        if value == low[axis]:  # more than half share the least value
            value = own[own[:, axis] > value, axis].min()
        left = own[:, axis] < value
        self.cut[node] = (axis, value)
        self.children[node] = (self._grow(members[left], leaf), self._grow(members[~left], leaf))
        return node

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lower one of equals) and its squared distance, for every point."""
        points = np.asarray(points, np.int64)
        entry, best = np.full(len(points), len(self.entries), np.int64), np.full(len(points), np.iinfo(np.int64).max)
        home = np.zeros(len(points), np.int64)
        if len(points):
            self._descend(0, points, np.arange(len(points)), entry, best, home)
            self._sweep(0, points, np.arange(len(points)), entry, best, home)
        return entry, best

    def _scan(self, node: int, points: np.ndarray, rows: np.ndarray, entry: np.ndarray, best: np.ndarray) -> None:
        members = self.leaves[node]
        distances = squared_distances(points[rows], self.entries[members])
        first = distances.argmin(1)  # members ascend, so it is the lowest index
        found, index = distances[np.arange(len(rows)), first], members[first]
        better = (found < best[rows]) | ((found == best[rows]) & (index < entry[rows]))
        best[rows[better]], entry[rows[better]] = found[better], index[better]

    def _descend(self, node: int, points: np.ndarray, rows: np.ndarray, entry: np.ndarray, best: np.ndarray, home: np.ndarray) -> None:
        if not rows.size:
            return
        if self.leaves[node] is not None:
            home[rows] = node
            self._scan(node, points, rows, entry, best)
            return
        (axis, value), (left, right) = self.cut[node], self.children[node]
        lower = points[rows, axis] < value
        self._descend(left, points, rows[lower], entry, best, home)
        self._descend(right, points, rows[~lower], entry, best, home)

    def _sweep(self, node: int, points: np.ndarray, rows: np.ndarray, entry: np.ndarray, best: np.ndarray, home: np.ndarray) -> None:
        own = points[rows]
        gap = np.maximum(np.maximum(self.low[node] - own, own - self.high[node]), 0)
        rows = rows[(gap * gap).sum(1) <= best[rows]]
        if not rows.size:
            return
        if self.leaves[node] is not None:
            if (rows := rows[home[rows] != node]).size:
                self._scan(node, points, rows, entry, best)
            return
        for child in self.children[node]:
            self._sweep(child, points, rows, entry, best, home)


def part_bounds(width: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and the last one ends; the first ones are one longer where it does not go even."""
    size, more = divmod(width, parts)
    return [k * size + min(k, more) for k in range(parts + 1)]


def finite(vector: str) -> Column:
    """Whether a vector is not null or empty and all components are finite numbers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


def usual_length(vectors: DataFrame, vector: str) -> int:
    """The length that most vectors have, the larger of equals; 0 for an empty table."""
    counts = vectors.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), F.desc("width"))
    return next((r["width"] for r in counts.take(1)), 0)


def quantized(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> tuple[DataFrame, int]:
    """vec_id, label and integer components of the rows that take part, written once; and the length of a vector."""
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").filter(finite("embedding"))
    width = usual_length(slim, "embedding")
    if not width:
        return slim.select("vec_id", "label", F.array().cast("array<int>").alias("cells")).limit(0), 0
    most = int(((1 << 62) / (4 * -(-width // parts))) ** 0.5)  # squared distances within a part stay below 2^62
    small = F.forall("embedding", lambda x: F.abs(x.cast("double") * scale) < min(most, 1 << 30))
    cells = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return stored(slim.filter((F.size("embedding") == width) & small).select("vec_id", "label", cells.alias("cells")), "cells"), width


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("cells").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def first_codebooks(rows: DataFrame, bounds: list[int], entries: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids, in order; at most ``entries`` rows reach the driver."""
    ids = [r["vec_id"] for r in rows.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()]
    known = [x for x in ids if x is not None]
    wanted = F.col("vec_id") <= (known[-1] if known else None)
    if None in ids:
        wanted = F.coalesce(wanted, F.lit(True))
    least = rows.filter(wanted).groupBy("vec_id").agg(F.min("cells").alias("cells")).orderBy(F.asc_nulls_last("vec_id")).collect() if ids else []
    whole = np.array([r["cells"] for r in least], np.int64).reshape(len(least), bounds[-1])
    return [whole[:, a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def entry_sums(rows: DataFrame, trees, bounds: list[int]) -> DataFrame:
    """part, entry, piece, number of parts assigned and their sums by position (s0 to s15), of each task and then of all."""
    width, parts = bounds[-1], len(bounds) - 1
    names = ["part", "entry", "piece", "n", *(f"s{k}" for k in range(PIECE))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(t.entries.shape, np.int64) for t in trees.value]
        counts = [np.zeros(len(t.entries), np.int64) for t in trees.value]
        for batch in batches:
            whole = _matrix(batch, width)
            for p in range(parts):
                own = whole[:, bounds[p] : bounds[p + 1]]
                if not own.shape[1] or not len(own):
                    continue
                entry, _ = trees.value[p].nearest(own)
                order = np.argsort(entry, kind="stable")
                used, starts, n = np.unique(entry[order], return_index=True, return_counts=True)
                sums[p][used] += np.add.reduceat(own[order], starts, axis=0)
                counts[p][used] += n
        for p in range(parts):
            used = np.flatnonzero(counts[p])
            for piece in range(-(-sums[p].shape[1] // PIECE)) if used.size else ():
                some = sums[p][used, piece * PIECE : (piece + 1) * PIECE]
                some = np.pad(some, ((0, 0), (0, PIECE - some.shape[1])))
                fixed = [np.full(used.size, p, np.int32), used.astype(np.int32), np.full(used.size, piece, np.int32), counts[p][used]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*fixed, *some.T)], names=names)

    schema = "part int, entry int, piece int, " + ", ".join(f"{c} long" for c in names[3:])
    own = rows.select("cells").mapInArrow(run, schema)
    return own.groupBy("part", "entry", "piece").agg(*(F.sum(c).alias(c) for c in names[3:]))


def next_codebooks(books: list[np.ndarray], sums: list) -> list[np.ndarray]:
    """Componentwise floor of the mean; entries without parts stay."""
    books = [b.copy() for b in books]
    for r in sums:
        book, at = books[r["part"]], r["piece"] * PIECE
        own = book[r["entry"], at : at + PIECE]
        own[:] = [r[f"s{k}"] // r["n"] for k in range(own.size)]
    return books


def train(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after ``rounds`` rounds over ``quantized`` rows."""
    context, bounds = rows.sparkSession.sparkContext, part_bounds(width, parts)
    books = first_codebooks(rows, bounds, entries)
    for _ in range(rounds if len(books[0]) else 0):
        trees = context.broadcast([KdTree(b) for b in books])
        books = next_codebooks(books, entry_sums(rows, trees, bounds).collect())
        trees.destroy()
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part) and the squared distance to what the code stands for."""
    bounds = np.cumsum([0, *(b.shape[1] for b in books)]).tolist()
    trees = rows.sparkSession.sparkContext.broadcast([KdTree(b) for b in books if len(b)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _matrix(batch, bounds[-1])
            codes, error = np.zeros((len(whole), len(bounds) - 1), np.uint8), np.zeros(len(whole), np.int64)
            for p, tree in enumerate(trees.value):
                if bounds[p] < bounds[p + 1]:
                    entry, distance = tree.nearest(whole[:, bounds[p] : bounds[p + 1]])
                    codes[:, p] = entry
                    error += distance
            text = pa.array([bytes(c).hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text, pa.array(error)], names=["vec_id", "label", "code", "error"])

    kind = dict(rows.dtypes)["label"]
    return rows.select("vec_id", "label", "cells").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def decoded(code: str, books: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for: the middle of its integer cells."""
    return (np.concatenate([b[i] for b, i in zip(books, bytes.fromhex(code), strict=True)]) + 0.5) / scale


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all integers by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all rows that take part (vec_id, label, code, error), written; and the codebooks. At most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits for each part: 1 to 256 entries")
    rows, width = quantized(vectors, scale, parts)
    books = train(rows, width, parts, entries, rounds) if width else [np.zeros((0, 0), np.int64)] * parts
    return stored(encode(rows, books), "codes"), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the errors of all rows with the same label (null is one) together. Sums per label are written before
    they meet the rows, so that Spark knows their size and can split the rows of a frequent label."""
    sums = stored(codes.groupBy(F.col("label").alias("own_label")).agg(F.expr("try_sum(error)").alias("label_error")), "label-errors")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("own_label"))).drop("own_label")
