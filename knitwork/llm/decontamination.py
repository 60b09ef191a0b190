"""Benchmark passages in training documents, by a distributed positional inverted index.

Every batch of documents becomes one index shard: for each term of the test set,
the sorted positions at which it occurs. Shards are written to the shared folder
once. Corpus-wide term counts, summed over all shards, order the terms of each
test window from the rarest; in each shard the posting list of the rarest term,
shifted by its offset in the window, is intersected with the shifted lists of
the rarer half and then the rest. A window is found where all ten lists agree
(phrase), or where every term lies within a given distance (proximity).

Test windows are searched in blocks of bounded size: what is collected and
broadcast at a time is one block, and the words of the test set. If those are
too many, the items are dealt into groups with an index each. Shards hold no
document twice and are searched where they lie; a row leaves them for each
document with hits, and these rows are merged by document and joined to the
list of all documents.

Defined cases: null has no words; empty items and documents match nothing; items
with the same words are each counted, and a repeated item id once; repeated
documents, and documents without an id, are reported once per row; items without
an id count together as one that is not in the item list; very long texts are
indexed whole; an empty table on either side gives documents without hits; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitwork.llm.common import pieces_of, stored, utf8

WINDOW = 10
#: Words by which a term may be off its place in a proximity match of the query.
SLOP = 4
#: UTF-8 bytes of test items in one block, but for a single longer item: the bound of the windows that are collected and broadcast at a time.
BLOCK_BYTES = 8_000_000
#: Different words of test items that are broadcast at a time, but for a single item with more.
MOST_TERMS = 2_000_000
#: Postings followed at a time within a shard, but for those of a single window.
CANDIDATES = 1_000_000
#: UTF-8 bytes of documents in one shard, but for a single longer document.
SHARD_BYTES = 8_000_000

#: Lower-cases A-Z and blanks out what is not part of a word: ASCII but letters and digits.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class TestWindows:
    """The windows of a block of items as rows of term numbers, -1 beyond the end of a short one; ``terms`` numbers the words of all blocks."""

    __test__ = False

    def __init__(self, items: list[tuple[object, bytes]], terms: dict[bytes, int], window: int) -> None:
        names: dict[str | None, int] = {}
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for item, text in items:
            ids = np.fromiter(map(terms.__getitem__, words(text)), np.int32)
            if not len(ids):
                continue
            k = names.setdefault(None if item is None else str(item), len(names))
            if len(ids) < window:
                ids = np.concatenate([ids, np.full(window - len(ids), -1, np.int32)])
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
            owners.append(np.full(len(rows[-1]), k, np.int64))
        self.items = list(names)
        every = np.ascontiguousarray(np.concatenate(rows))
        _, first, same = np.unique(every.view(f"V{every.itemsize * window}").ravel(), return_index=True, return_inverse=True)
        self.windows = every[first]
        self.lengths = (self.windows >= 0).sum(1)
        pairs = np.unique(same.ravel() * max(1, len(names)) + np.concatenate(owners))
        which, self.owned = np.divmod(pairs, max(1, len(names)))
        self.owners = np.searchsorted(which, np.arange(len(first) + 1))

    def rarest_first(self, counts: np.ndarray) -> None:
        """Offsets of each window's terms, by rising corpus count; ties in text order."""
        cost = np.where(self.windows >= 0, counts[self.windows] if len(counts) else 0, np.iinfo(np.int64).max)
        self.order = np.argsort(cost, axis=1, kind="stable").astype(np.int8)


def term_list(items: DataFrame) -> DataFrame:
    """(part, term): the different words of the items of each part."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in zip(batch.column("part").to_pylist(), utf8(batch), strict=True):
                own = sorted(set(words(text)))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(own), pa.int64()), pa.array(own, pa.binary())], names=["part", "term"])

    return items.select("part", "text").mapInArrow(split, "part long, term binary").distinct()


def index(docs: DataFrame, terms: dict[bytes, int], gap: int = WINDOW) -> DataFrame:
    """One shard per batch of documents (row_key, doc_id, text). Positions run through the shard, with a gap after each document that no match spans."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    schema = "row_keys array<long>, doc_ids array<long>, starts array<long>, n_words array<long>, terms array<int>, counts array<long>, postings binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in pieces_of(batches, SHARD_BYTES):
            keys, ids, n_words, found, starts, at = batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist(), [], [], [], 0
            for text in utf8(batch):
                own = words(text)
                found.append(np.fromiter(map(number.get, own, repeat(-1)), np.int32, len(own)))
                found.append(np.full(gap, -1, np.int32))
                n_words.append(len(own))
                starts.append(at)
                at += len(own) + gap
            stream = np.concatenate(found) if found else np.zeros(0, np.int32)
            positions = np.flatnonzero(stream >= 0)
            order = np.argsort(stream[positions], kind="stable")
            present, counts = np.unique(stream[positions], return_counts=True)
            row = [keys, ids, starts, n_words, present.tolist(), counts.tolist(), positions[order].astype("<u4").tobytes()]
            kinds = [pa.list_(pa.int64())] * 4 + [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["row_keys", "doc_ids", "starts", "n_words", "terms", "counts", "postings"])

    return docs.select("row_key", "doc_id", "text").mapInArrow(build, schema)


def term_counts(shards: DataFrame, n_terms: int) -> np.ndarray:
    """Occurrences of each test term in all documents."""
    rows = (
        shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
        .groupBy(F.col("t.terms").alias("term"))
        .agg(F.sum("t.counts").alias("n"))
        .toArrow()
    )
    out = np.zeros(n_terms, np.int64)
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return out


class Shard:
    """Posting lists of one shard: position ``p`` of term ``t`` is kept as t * span + p, in order. ``terms`` are those that occur, rising."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, postings: bytes, span: int) -> None:
        self._span = span
        positions = np.frombuffer(postings, "<u4").astype(np.int64)
        self._keys = np.repeat(terms.astype(np.int64), counts) * span + positions
        self._positions, self._terms, self._counts = positions, terms, counts
        self._from = np.cumsum(counts) - counts

    def _at(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each term among those that occur, and whether it does."""
        if not len(self._terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), bool)
        at = np.minimum(np.searchsorted(self._terms, terms), len(self._terms) - 1)
        return at, self._terms[at] == terms

    def sizes(self, terms: np.ndarray) -> np.ndarray:
        """Number of postings of each of ``terms``."""
        at, known = self._at(terms)
        return np.where(known, self._counts[at], 0) if len(self._terms) else np.zeros(len(terms), np.int64)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row number and position for every posting of ``terms``, all of which occur."""
        at, _ = self._at(terms)
        sizes = self._counts[at] if len(terms) else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(len(terms)), sizes)
        inside = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return rows, self._positions[self._from[at][rows] + inside]

    def has(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term has a posting in low ... high."""
        low, high = np.maximum(low, 0), np.minimum(high, self._span - 1)
        if not len(self._keys):
            return np.zeros(len(terms), bool)
        at = np.searchsorted(self._keys, terms.astype(np.int64) * self._span + low)
        nearest = self._keys[np.minimum(at, len(self._keys) - 1)]
        return (at < len(self._keys)) & (nearest <= terms.astype(np.int64) * self._span + high)


def _some_windows(shard: Shard, tests: TestWindows, own: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    order = tests.order[own].astype(np.int64)
    which, position = shard.lists(tests.windows[own, order[:, 0]])
    start = position - order[which, 0]
    for k in range(1, tests.windows.shape[1]):
        offset = order[which, k]
        term = tests.windows[own[which], offset]
        here = term < 0
        if (~here).any():
            here[~here] = shard.has(term[~here], (start + offset - slop)[~here], (start + offset + slop)[~here])
        which, start = which[here], start[here]
    return own[which], start


def search(shard: Shard, tests: TestWindows, slop: int = 0, most: int = CANDIDATES) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) for each occurrence. With ``slop``, the start of the rarest term's shift, other terms within that distance of their place."""
    which, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(tests.windows):
        sizes = shard.sizes(tests.windows[np.arange(len(tests.windows)), tests.order[:, 0].astype(np.int64)])
        present = np.flatnonzero(sizes)
        for own in np.split(present, np.flatnonzero(np.diff(np.cumsum(sizes[present]) // most)) + 1):
            w, s = _some_windows(shard, tests, own, slop)
            which.append(w)
            start.append(s)
    return np.concatenate(which), np.concatenate(start)


_HITS = "row_key long, hit array<long>, items array<string>, unnamed boolean, n_near long"


def _hits(shards: DataFrame, tests: TestWindows, slop: int) -> DataFrame:
    """A row per document with a match: the places of its words inside windows, and the items found."""
    sent = shards.sparkSession.sparkContext.broadcast(tests)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda name: batch.column(name)[row]  # noqa: B023, E731
                keys, n_words, starts = (np.array(value(name).as_py(), np.int64) for name in ("row_keys", "n_words", "starts"))
                span = int(starts[-1] + n_words[-1]) + tests.windows.shape[1] if len(starts) else 1
                shard = Shard(np.array(value("terms").as_py(), np.int64), np.array(value("counts").as_py(), np.int64), value("postings").as_py(), span)
                which, start = search(shard, tests)
                doc = np.searchsorted(starts, start, "right") - 1
                # every word inside an occurrence, by the change of the number of open occurrences
                depth = np.zeros(span + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + tests.lengths[which], -1)
                hit = np.cumsum(depth) > 0
                sizes = tests.owners[which + 1] - tests.owners[which]
                inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                n_items = max(1, len(tests.items))
                pairs = np.unique(np.repeat(doc, sizes) * n_items + tests.owned[np.repeat(tests.owners[which], sizes) + inside])
                items: dict[int, list[str | None]] = {}
                for d, k in zip(*(x.tolist() for x in np.divmod(pairs, n_items)), strict=True):
                    items.setdefault(d, []).append(tests.items[k])
                near: dict[int, int] = {}
                if slop:
                    w, s = search(shard, tests, slop)
                    at = np.searchsorted(starts, s + tests.order[w, 0], "right") - 1
                    near = dict(zip(*(x.tolist() for x in np.unique(at, return_counts=True)), strict=True))
                found = sorted(items.keys() | near.keys())
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys[found], pa.int64()), pa.array([np.flatnonzero(hit[starts[k] : starts[k] + n_words[k]]) for k in found], pa.list_(pa.int64())),
                    pa.array([[x for x in items.get(k, ()) if x is not None] for k in found], pa.list_(pa.string())), pa.array([None in items.get(k, ()) for k in found], pa.bool_()),
                    pa.array([near.get(k, 0) for k in found], pa.int64()),
                ], names=["row_key", "hit", "items", "unnamed", "n_near"])

    return shards.mapInArrow(match, _HITS)


def _dealt(items: DataFrame, parts: int) -> DataFrame:
    return items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))


def _groups(items: DataFrame, most: int) -> int:
    """How many groups the items are dealt into, so that none has more than ``most`` different words, but for single items."""
    groups, n_items = 1, None
    while True:
        largest = term_list(_dealt(items, groups)).groupBy("part").count().agg(F.max("count")).collect()[0][0] or 0
        if largest <= most:
            return groups
        n_items = n_items or items.count()
        if groups >= 8 * n_items:
            return groups
        groups *= 2


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES, most_terms: int = MOST_TERMS) -> DataFrame:
    """Per document: words, words inside benchmark windows, items found, and (with ``slop``) proximity matches."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row_key"))
    groups = _groups(items, most_terms)
    if groups > 1:  # every index has to see the same keys
        keyed = stored(keyed, "keyed-documents")
    every = hits = None
    for group in range(groups):
        own = items if groups == 1 else _dealt(items, groups).filter(F.col("part") == group).drop("part")
        terms = {r["term"]: k for k, r in enumerate(term_list(own.withColumn("part", F.lit(0))).orderBy("term").toLocalIterator())}
        terms = {bytes(k): v for k, v in terms.items()}
        shards = stored(index(keyed, terms, window + slop), "postings")
        counts = term_counts(shards, len(terms))
        if every is None:
            listed = F.explode(F.arrays_zip("row_keys", "doc_ids", "n_words")).alias("d")
            every = shards.select(listed).select(F.col("d.row_keys").alias("row_key"), F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))
        total = own.agg(F.sum(F.octet_length("text") + F.lit(64)).alias("n")).collect()[0]["n"] or 0
        blocks = max(1, math.ceil(total / block_bytes))
        for block in range(blocks):
            rows = (own if blocks == 1 else _dealt(own, groups * blocks).filter(F.col("part") == group + groups * block)).toArrow()
            texts = [b"" if x is None else x.encode() for x in rows.column("text").to_pylist()]
            tests = TestWindows(list(zip(rows.column("item_id").to_pylist(), texts, strict=True)), terms, window)
            tests.rarest_first(counts)
            here = _hits(shards, tests, slop)
            hits = here if hits is None else hits.unionByName(here)
    # all rows of a document together: as many as there are blocks in which it has a match
    merged = hits.groupBy("row_key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("unnamed").alias("unnamed"), F.sum("n_near").alias("n_near"),
    )
    none = F.array().cast("array<string>")
    out = every.join(merged, "row_key", "left").withColumns({"items": F.coalesce("items", none), "n_hit": F.coalesce("n_hit", F.lit(0)), "n_near": F.coalesce("n_near", F.lit(0))})
    return out.select(
        "doc_id", "n_words", "n_hit", (F.size("items") + F.coalesce(F.col("unnamed").cast("int"), F.lit(0))).cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "n_near",
    )
