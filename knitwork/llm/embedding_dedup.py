"""Near-duplicate embeddings by randomised-rotation binary codes.

Each unit vector is rotated at random and kept as its sign code with one
correction factor, the inner product of code and vector; both are computed once
and stored. The inner product of a query with a code, divided by the factor, is
an unbiased estimate of the cosine; a bound on its error decides which pairs are
recomputed in double precision. The default bound is the certain one (vector,
code and query obey the spherical triangle inequality), so no link is lost;
``epsilon`` takes the confidence bound of the estimator where that is tighter.

Equal vectors are collapsed first. The rest of a label is cut into cells around
a bounded sample of pivots, and cells into blocks; blocks are compared with
larger blocks of codes, but only those whose cones come within the angle of the
threshold. A first pass over rotated vectors on one side and codes on the other
names the rows with an undecided pair; only those send their vectors to a second
pass, which computes the cosines. It reports link counts and a spanning forest,
never its links.

Defined cases: null labels, null, empty or zero vectors, vectors with null or
non-finite components, and vectors without an id link with nothing; vectors of
different lengths are never compared; repeated rows are copies that link with
each other; rows with one id and different vectors are in one component; an
empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitwork.llm.common import stored
from knitwork.llm.components import components

THRESHOLD = 0.93
#: Vectors of a block, blocks whose codes are compared with one block at a time, and pivots at most.
BLOCK, CODE_BLOCKS, MOST_PIVOTS = 2048, 16, 1024
#: Rows of a block compared at a time, and distance from the threshold within which a cosine is summed again without rounding.
SLAB, DOUBT = 128, 1e-9
ROTATION_SEED = 17

_ROWS = "vec_id long, grp string, key binary, vector array<double>"


def _unit(values: list | None) -> np.ndarray | None:
    if not values or None in values:
        return None
    v = np.array(values, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def prepared(vectors: DataFrame) -> DataFrame:
    """Unit vectors with their group (label and length) and a key that equal vectors share; both null where nothing can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vec, label, values in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding")), strict=True):
                unit = None if vec is None or label is None else _unit(values)
                if unit is None:
                    out.append((vec, None, None, None))
                else:
                    grp = f"{len(unit)}/{label}"
                    key = hashlib.blake2b(grp.encode() + b"/" + np.array(values, np.float64).tobytes(), digest_size=16).digest()
                    out.append((vec, grp, key, unit))
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["vec_id", "grp", "key", "vector"])

    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return slim.mapInArrow(run, _ROWS)


@lru_cache(maxsize=4)
def _rotation(dimension: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))[0]


class Codes:
    """Sign codes of rotated unit vectors with their correction factors."""

    def __init__(self, vectors: np.ndarray, seed: int = ROTATION_SEED) -> None:
        self.dimension = vectors.shape[1]
        self.rotated = vectors @ _rotation(self.dimension, seed)
        self.bits = np.packbits(self.rotated >= 0, axis=1)
        self.factor = np.abs(self.rotated).sum(1) / math.sqrt(self.dimension)

    @classmethod
    def stored(cls, bits: np.ndarray, factor: np.ndarray, dimension: int) -> Codes:
        """Codes without their vectors."""
        codes = cls.__new__(cls)
        codes.bits, codes.factor, codes.dimension = bits, factor, dimension
        return codes

    def signs(self) -> np.ndarray:
        return (np.unpackbits(self.bits, axis=1, count=self.dimension).astype(np.float32) * 2 - 1) / math.sqrt(self.dimension)


def estimates(queries: np.ndarray, codes: Codes, epsilon: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased cosine estimates of rotated queries with coded vectors, and upper bounds of the cosines."""
    a = np.clip(queries.astype(np.float32) @ codes.signs().T, -1, 1)
    f = codes.factor.astype(np.float32)[None]
    # no vector is further from the query than the detour over its code
    upper = np.where(a > f, 1, f * a + np.sqrt(np.maximum(0, (1 - f * f) * (1 - a * a))))
    estimate = a / f
    if epsilon is not None:
        upper = np.minimum(upper, estimate + epsilon * np.sqrt(np.maximum(0, 1 - f * f)) / f / math.sqrt(max(1, queries.shape[1] - 1)))
    return estimate, upper


def undecided(queries: np.ndarray, codes: Codes, threshold: float, epsilon: float | None = None, allowed: Callable[[int, int], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which queries and which coded vectors are in a pair whose bound reaches the threshold; ``allowed`` masks the pairs of a slab."""
    left, right = np.zeros(len(queries), bool), np.zeros(len(codes.bits), bool)
    for at in range(0, len(queries), SLAB):
        _, upper = estimates(queries[at : at + SLAB], codes, epsilon)
        open_ = upper >= threshold - 1e-5
        if allowed is not None:
            open_ &= allowed(at, at + SLAB)
        left[at : at + SLAB] = open_.any(1)
        right |= open_.any(0)
    return left, right


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of left, row of right) of the pairs with a cosine at or above the threshold, slab by slab."""
    for at in range(0, len(left), SLAB):
        cosine = left[at : at + SLAB] @ right.T
        i, j = np.nonzero(cosine >= threshold - DOUBT)
        close = np.flatnonzero(cosine[i, j] < threshold + DOUBT)
        sure = np.ones(len(i), bool)
        sure[close] = [math.fsum(left[at + x] * right[y]) >= threshold for x, y in zip(i[close], j[close], strict=True)]
        yield at + i[sure], j[sure]


def _spread(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after every linked pair has taken the smaller one, until nothing changes."""
    while True:
        least = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        if (after == label).all():
            return after
        label = after


#: A block and the codes that it is compared with.
_PAIR = ["grp", "cell", "part", "r_cell", "r_sup"]


def _first_pass(threshold: float, epsilon: float | None) -> Callable[[pa.Table], pa.Table]:
    """The rows of a block (side 0) and of its codes (side 1) that are in an undecided pair."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        side = table.column("side").to_numpy()
        a, b = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        rows = lambda t, name, kind: np.frombuffer(b"".join(t.column(name).to_pylist()), kind).reshape(t.num_rows, -1)
        keep = np.zeros(0, bool), np.zeros(0, bool)
        if a.num_rows and b.num_rows:
            queries = rows(a, "rotated", "<f4")
            codes = Codes.stored(rows(b, "bits", np.uint8), b.column("factor").to_numpy(), queries.shape[1])
            allowed = None
            if table.column("cell")[0] == table.column("r_cell")[0] and table.column("part")[0].as_py() // CODE_BLOCKS == table.column("r_sup")[0].as_py():
                # the rows of the block are among the codes, and keys are sorted: each meets those after its own
                known = {k: n for n, k in enumerate(b.column("key").to_pylist())}
                place, n = np.array([known[k] for k in a.column("key").to_pylist()]), len(known)
                allowed = lambda x, y: place[x:y, None] < np.arange(n)[None]
            keep = undecided(queries, codes, threshold, epsilon, allowed)
        out = pa.concat_tables([t.filter(pa.array(k)) if len(k) else t.slice(0, 0) for t, k in zip((a, b), keep, strict=True)])
        return out.select([*_PAIR, "side", "key"])

    return compare


def _second_pass(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Link counts by key, and a spanning forest of (a, b), of the pairs between two sets of rows."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        side, copies, ids = (table.column(c).to_numpy() for c in ("side", "copies", "rep"))
        keys = np.array(table.column("key").to_pylist(), object)
        vectors = table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        within = table.column("cell")[0] == table.column("r_cell")[0] and table.column("part")[0].as_py() // CODE_BLOCKS == table.column("r_sup")[0].as_py()
        links, label = np.zeros(len(ids), np.int64), ids.copy()
        if len(a) and len(b):
            for i, j in linked(vectors[a], vectors[b], threshold):
                i, j = a[i], b[j]
                if within:  # both rows may be on both sides
                    once = keys[i] < keys[j]
                    i, j = i[once], j[once]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                label = _spread(label, i, j)
        at, moved = np.flatnonzero(links), np.flatnonzero(label != ids)
        empty = lambda n: [None] * n
        return pa.table({
            "key": pa.array([*keys[at], *empty(len(moved))], pa.binary()), "links": pa.array([*links[at], *empty(len(moved))], pa.int64()),
            "a": pa.array([*empty(len(at)), *ids[moved]], pa.int64()), "b": pa.array([*empty(len(at)), *label[moved]], pa.int64()),
        })

    return compare


def _pivots(reps: DataFrame, number: int) -> np.ndarray | None:
    """Vectors with the smallest hashes: a bounded sample of one length."""
    if number < 2:
        return None
    rows = reps.orderBy(F.xxhash64("rep", F.lit(3))).limit(number).select("vector").collect()
    width = max(len(r["vector"]) for r in rows)
    return np.array([r["vector"] for r in rows if len(r["vector"]) == width])


_CODED = "key binary, grp string, rep long, cell int, angle double, rotated binary, bits binary, factor float"


def coded(reps: DataFrame, pivots: np.ndarray | None, seed: int = ROTATION_SEED) -> DataFrame:
    """Rotated vector, code and correction factor of every distinct vector, its nearest pivot and the angle to that."""
    sent = reps.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            sizes = np.array([len(v) for v in vectors])
            out = [None] * len(vectors)
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                own = np.array([vectors[k] for k in rows])
                codes = Codes(own, seed)
                cells, angles = np.zeros(len(rows), np.int64), np.full(len(rows), math.pi)
                if centres is not None and centres.shape[1] == d:
                    cosine = own @ centres.T
                    cells, angles = cosine.argmax(1), np.arccos(np.clip(cosine.max(1), -1, 1))
                for k, *row in zip(rows, cells, angles, codes.rotated.astype("<f4"), codes.bits, codes.factor, strict=True):
                    out[k] = (int(row[0]), float(row[1]), row[2].tobytes(), row[3].tobytes(), float(row[4]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.float32()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "grp", "rep")), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["key", "grp", "rep", "cell", "angle", "rotated", "bits", "factor"]
            )

    return reps.select("key", "grp", "rep", "vector").mapInArrow(run, _CODED)


def _near(pairs: DataFrame, pivots: np.ndarray | None, threshold: float) -> DataFrame:
    """Pairs (cell, radius, r_cell, r_radius) whose cones come within the angle of the threshold."""
    if pivots is None:
        return pairs
    sent = pairs.sparkSession.sparkContext.broadcast(np.arccos(np.clip(pivots @ pivots.T, -1, 1)).astype(np.float32))
    most = math.acos(threshold) + 1e-5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = sent.value
        for batch in batches:
            cell, radius, r_cell, r_radius = (batch.column(c).to_numpy() for c in ("cell", "radius", "r_cell", "r_radius"))
            yield batch.filter(pa.array(apart[cell, r_cell] - radius - r_radius <= most))

    return pairs.mapInArrow(run, pairs.schema)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, epsilon: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row per vector."""
    rows = stored(prepared(vectors), "vectors")
    usable = rows.filter(F.col("key").isNotNull())
    reps = usable.groupBy("key").agg(F.min("grp").alias("grp"), F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    reps = stored(reps, "distinct-vectors")
    most = reps.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n")).collect()[0][0] or 0
    pivots = _pivots(reps, min(MOST_PIVOTS, math.ceil(most / block)))
    codes = stored(coded(reps, pivots), "codes")
    parts = stored(codes.groupBy("grp", "cell").agg(F.ceil(F.count("*") / F.lit(block)).alias("parts"), F.max("angle").alias("radius")), "cells")
    placed = codes.join(parts.drop("radius"), ["grp", "cell"]).withColumn("part", F.pmod(F.xxhash64("key", F.lit(5)), "parts"))
    placed = stored(placed.withColumn("sup", F.floor(F.col("part") / CODE_BLOCKS)).drop("parts"), "placed-codes")

    # cells with cells, then blocks of near cells with blocks of codes
    cells = parts.select("grp", "cell", "radius")
    meeting = _near(cells.join(cells.select("grp", F.col("cell").alias("r_cell"), F.col("radius").alias("r_radius")), "grp").filter("cell <= r_cell"), pivots, threshold)
    meeting = stored(meeting.select("grp", "cell", "r_cell"), "near-cells")
    blocks = placed.groupBy("grp", "cell", "part").agg(F.max("angle").alias("radius"))
    sups = placed.groupBy("grp", F.col("cell").alias("r_cell"), F.col("sup").alias("r_sup")).agg(F.max("angle").alias("r_radius"))
    pairs = meeting.join(blocks, ["grp", "cell"]).join(sups, ["grp", "r_cell"])
    pairs = pairs.filter((F.col("cell") < F.col("r_cell")) | (F.floor(F.col("part") / CODE_BLOCKS) <= F.col("r_sup")))
    pairs = stored(_near(pairs, pivots, threshold).select(*_PAIR), "block-pairs")

    queries = placed.select("grp", "cell", "part", "key", "rotated").join(pairs, ["grp", "cell", "part"])
    queries = queries.select(*_PAIR, F.lit(0).alias("side"), "key", "rotated", F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("float").alias("factor"))
    others = placed.select("grp", F.col("cell").alias("r_cell"), F.col("sup").alias("r_sup"), "key", "bits", "factor").join(pairs, ["grp", "r_cell", "r_sup"])
    others = others.select(*_PAIR, F.lit(1).alias("side"), "key", F.lit(None).cast("binary").alias("rotated"), "bits", "factor")
    kinds = "grp string, cell int, part long, r_cell int, r_sup long, side int, key binary"
    named = stored(queries.unionByName(others).groupBy(*_PAIR).applyInArrow(_first_pass(threshold, epsilon), kinds), "undecided")
    found = named.join(reps.select("key", "rep", "copies", "vector"), "key").groupBy(*_PAIR).applyInArrow(_second_pass(threshold), "key binary, links long, a long, b long")
    found = stored(found, "vector-links")

    counts = found.filter(F.col("key").isNotNull()).groupBy("key").agg(F.sum("links").alias("links"))
    labels = components(found.filter(F.col("key").isNull()).select("a", "b"))
    known = reps.select("key", "rep", "copies").join(counts, "key", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(F.col("key").alias("k"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "key").join(known, F.col("key") == F.col("k"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
