"""Jaccard similarity join of documents on word n-grams, by rare-first prefix filtering.

1. Every document becomes the set of its distinct n-gram hashes; documents with
   equal sets are one node from then on. In the same pass all n-grams of all
   documents are counted into a hashed table of fixed size.
2. A set is ordered from rare to frequent. Two sets that reach the similarity
   share one of their first n-grams, so only those prefixes are joined.
3. Pairs with a common prefix n-gram pass a length filter, a positional filter
   (what may still follow) and a suffix filter (numbers of n-grams by range of
   the hash must not differ too much), and are verified once, on the whole sets.

Nodes that share an n-gram are not paired all with all. Two rounds pair each
with the likely original of its own bucket, components are formed from the
verified links, and then all pairs across different components are looked at. So
no link between components is lost, while a large group of copies costs a few
pairs per document.

Links within components are counted afterwards, each pair of nodes once: all nodes
of a component are compared with each other by products of their incidence with
n-grams, in blocks of bounded size, a large component in pairs of blocks. That
names no pair, only numbers; n-grams of a few nodes are paired directly.

An n-gram that the counts show in many documents is dealt to several tasks, each
with an original of its own; these are paired with the first of them. Elsewhere
tables are written before they meet a table with a hot key, so that Spark knows
their size and can split the key's rows.

Defined cases: null and empty texts have no n-grams and link with nothing; with
fewer words than n the whole sequence is the one n-gram; a null id links with
nothing and has no component; repeated rows are copies, and so are rows with one
id and different texts if their texts link; very long texts are taken whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knitwork.llm.common import give_back, pieces_of, stored, trim, utf8
from knitwork.llm.components import components

#: Counters of n-gram frequencies: a fixed table, whatever the input.
COUNTERS = 1 << 20
#: Partial counter tables summed at a time, and slices of a table.
FAN_IN, SLICES = 32, 16
#: Words whose hashes a worker keeps.
CACHE_WORDS = 100_000
#: UTF-8 bytes of documents handled at a time, but for a single longer one.
PIECE_BYTES = 4_000_000
#: Documents with an n-gram that go to one task, about, and how far above the mean a counter has to be for its n-grams to be split.
BUCKET, HOT_FACTOR = 1024, 8
#: Nodes and n-grams of a block within which links are counted, about; n-grams counted by one product; and nodes up to which an n-gram's are paired.
BLOCK_NODES, BLOCK_GRAMS, COLUMNS, RARE = 1024, 1_000_000, 2048, 8
#: Ranges of the hash (by its first byte) that the suffix filter counts by.
RANGES = 256

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        if len(self) < CACHE_WORDS:
            self[word] = got
        return got


@lru_cache(maxsize=1)
def _word_hashes() -> _WordHashes:
    """One per worker process; given back at the end of a task."""
    return _WordHashes()


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


def ngram_hashes(text: bytes, width: int) -> np.ndarray:
    """Hash of every n-gram of a text, in order: a polynomial in the hashes of its words."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_word_hashes().__getitem__, words), np.int64, len(words)).view(np.uint64)
    size = min(width, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h *= _MULTIPLIER
        h += w[k : k + n]
    return _mixed(h)


def ngram_set(text: bytes, width: int) -> np.ndarray:
    """Distinct hashes, sorted."""
    h = ngram_hashes(text, width)
    h.sort()
    return h if len(h) < 2 else h[np.concatenate([[True], h[1:] != h[:-1]])]


_SIGNED = "kind int, doc_id long, text_key long, n long, f1 long, f2 long, ranges array<tinyint>, task long, slice int, counts binary"


def signatures(docs: DataFrame, width: int, counters: int = COUNTERS) -> DataFrame:
    """kind 0: a row per document with size, 128-bit set hash and range counts; kind 1: counters of a task, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.uint32)
        names = ["kind", "doc_id", "text_key", "n", "f1", "f2", "ranges", "task", "slice", "counts"]
        kinds = [pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int8()), pa.int64(), pa.int32(), pa.binary()]
        for batch in pieces_of(batches, PIECE_BYTES):
            rows, held, size = [], [], 0
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), utf8(batch), strict=True):
                own = ngram_set(text, width)
                if len(own):
                    f = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                    rows.append((0, doc, key, len(own), int(f[0]), int(f[1]), np.minimum(np.bincount(own >> np.uint64(56), minlength=RANGES), 127).astype(np.int8)))
                    held.append((own & np.uint64(counters - 1)).astype(np.int64))
                    size += len(own)
                else:
                    rows.append((0, doc, key, 0, None, None, None))
                if size > 500_000:
                    total += np.bincount(np.concatenate(held), minlength=counters).astype(np.uint32)
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=counters).astype(np.uint32)
            cols = list(zip(*rows, strict=True)) or [()] * 7
            cols += [[None] * len(rows)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        _word_hashes.cache_clear()
        trim()
        if total.any():
            task = TaskContext.get().partitionId()
            for k, part in enumerate(np.split(total, SLICES)):
                row = [1, *[None] * 6, task, k, part.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, _SIGNED)


def frequencies(signed: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """Counts of all n-grams by counter: partial tables are summed in a tree of bounded groups."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in table.column("counts").to_pylist())
        first = table.slice(0, 1)
        return pa.table({"task": first.column("task"), "slice": first.column("slice"), "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})

    tables = signed.filter("kind = 1").select((F.col("task") / FAN_IN).cast("long").alias("task"), "slice", "counts")
    most = tables.agg(F.max("task")).collect()[0][0]
    out = np.zeros(counters, np.uint32)
    if most is None:
        return out
    while True:
        tables = tables.groupBy("task", "slice").applyInArrow(add, "task long, slice int, counts binary")
        if most == 0:
            break
        tables, most = stored(tables, "counters").withColumn("task", (F.col("task") / FAN_IN).cast("long")), most // FAN_IN
    size = counters // SLICES
    for row in tables.collect():
        out[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(row["counts"], np.uint32)
    return out


def overlap_needed(n: Column, m: Column, num: int, den: int) -> Column:
    """Smallest common number for den * common >= num * union."""
    return F.ceil((n + m) * F.lit(num) / F.lit(num + den) - F.lit(1e-9))


def prefixes(docs: DataFrame, width: int, num: int, den: int, counts: np.ndarray, bucket: int = BUCKET) -> DataFrame:
    """The first n-grams of every set, rarest first: any two sets that reach the similarity share one. ``salt`` is -1 where one task can take all of an n-gram."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        mask = np.uint64(len(counts) - 1)
        # a counter far above the mean holds an n-gram of many documents; the mean itself grows with the corpus
        unit = max(bucket, HOT_FACTOR * int(counts.mean()))
        sent_before: set[bytes] = set()
        for batch in pieces_of(batches, PIECE_BYTES):
            parts: list[tuple] = []
            for text in utf8(batch):
                own = ngram_set(text, width)
                if not len(own):
                    continue
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                if digest in sent_before:  # copies within a task; others meet at the join
                    continue
                if len(sent_before) < 1_000_000:
                    sent_before.add(digest)
                n = len(own)
                first = n - -(-num * n // den) + 1
                rank = (np.minimum(counts[own & mask], (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (own >> np.uint64(24))
                order = np.argpartition(rank, first - 1)[:first] if first < n else np.arange(n)
                order = np.sort(order)
                order = order[np.argsort(rank[order], kind="stable")]
                f1, f2 = np.frombuffer(digest, np.int64)
                parts.append((own[order].view(np.int64), f1, f2, n, first))
            if not parts:
                continue
            sizes = np.array([p[4] for p in parts])
            each = lambda k: np.repeat(np.array([p[k] for p in parts], np.int64), sizes)  # noqa: B023, E731
            h, place = np.concatenate([p[0] for p in parts]), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            f1, f2, n = each(1), each(2), each(3)
            shares = -(-counts[h.view(np.uint64) & mask].astype(np.int64) // unit)
            salt = np.where(shares > 1, f1 % np.maximum(shares, 1), -1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, f1, f2, n, place, salt)], names=["h", "f1", "f2", "n", "place", "salt"])
        sent_before.clear()
        _word_hashes.cache_clear()
        trim()

    return docs.select("text").mapInArrow(run, "h long, f1 long, f2 long, n long, place long, salt long")


#: What a bucket's centre is the first in: a text from which others were copied with changes has the fewest
#: n-grams of its own, so that the shared ones come earliest in its order.
_FIRST = ["place", "f1", "f2"]


def _length_class(round_: int, num: int, den: int) -> Column:
    """Classes of similar size, shifted by half a class in every second round."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + F.lit(0.5 * (round_ % 2))).cast("long")


def shared_buckets(entries: DataFrame, num: int, den: int) -> DataFrame:
    """kind 0: entries whose n-gram several nodes have; kind 1: each of them with the first node of its size class; kind 2: such first nodes, where an n-gram went to several tasks.

    One exchange by n-gram and salt; a sorted stream sees the nodes of a bucket one after the other, so no bucket is held in memory.
    """
    dealt = entries.withColumn("cls", _length_class(0, num, den)).repartition("h", "salt").sortWithinPartitions("h", "salt", "cls", *_FIRST)
    names = ["h", "f1", "f2", "n", "place", "cls"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # last row so far, whether the row before it has its n-gram, and the first of its class
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c).to_numpy() for c in (*names, "salt")}
            first_h, first_m = False, None
            if held is not None:
                row, first_h, first_m = held
                cols = {c: np.concatenate([[row[c]], v]) for c, v in cols.items()}
            same = lambda c: cols[c][1:] == cols[c][:-1]  # noqa: B023, E731
            again = np.concatenate([[False], same("h") & same("salt") & same("f1") & same("f2")])
            if again.any():
                cols = {c: v[~again] for c, v in cols.items()}
            size = len(cols["h"])
            same_h = np.concatenate([[False], same("h") & same("salt")])
            same_cls = same_h & np.concatenate([[False], same("cls")])
            start = np.maximum.accumulate(np.where(same_cls, 0, np.arange(size)))
            centre = {c: cols[c][start] for c in names}
            if first_m is not None:
                for c in names:
                    centre[c][start == 0] = first_m[c]
            same_h[0] = first_h
            in_bucket = same_h | np.concatenate([same_h[1:], [False]]) | (cols["salt"] >= 0)
            last = size - 1
            held = ({c: v[last] for c, v in cols.items()}, bool(same_h[last]), {c: v[last] for c, v in centre.items()})
            yield _bucket_rows(cols, centre, in_bucket[:last], last)
        if held is not None:
            row, before, centre = held
            one = lambda d: {c: np.array([v]) for c, v in d.items()}
            yield _bucket_rows(one(row), one(centre), np.array([before or row["salt"] >= 0]), 1)

    def _bucket_rows(cols: dict, centre: dict, keep: np.ndarray, size: int) -> pa.RecordBatch:
        rows = np.flatnonzero(keep)
        other = (cols["f1"][:size] != centre["f1"][:size]) | (cols["f2"][:size] != centre["f2"][:size])
        pair, first = rows[other[rows]], rows[~other[rows] & (cols["salt"][:size][rows] >= 0)]
        taken = np.concatenate([rows, pair, first])
        out = [pa.array(np.repeat(np.array([0, 1, 2], np.int32), [len(rows), len(pair), len(first)]))]
        out += [pa.array(cols[c][:size][taken]) for c in names]
        out += [pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(centre[c][:size][pair]), pa.nulls(len(first), pa.int64())]) for c in ("f1", "f2", "n", "place")]
        return pa.RecordBatch.from_arrays(out, names=["kind", *names, "g1", "g2", "m", "spot"])

    return dealt.mapInArrow(run, "kind int, h long, f1 long, f2 long, n long, place long, cls long, g1 long, g2 long, m long, spot long")


def _first_pairs(found: DataFrame) -> DataFrame:
    """Nodes with the first of their bucket, and the first nodes of the shares of one n-gram with the first of them."""
    columns = ["f1", "f2", "n", "place", "g1", "g2", "m", "spot"]
    firsts = found.filter("kind = 2").select("h", "cls", "f1", "f2", "n", "place")
    centre = stored(firsts.groupBy("h", "cls").agg(F.min(F.struct(*_FIRST, "n")).alias("c")), "centres")
    of_shares = firsts.join(centre.hint("merge"), ["h", "cls"]).filter((F.col("f1") != F.col("c.f1")) | (F.col("f2") != F.col("c.f2")))
    of_shares = of_shares.select("f1", "f2", "n", "place", F.col("c.f1").alias("g1"), F.col("c.f2").alias("g2"), F.col("c.n").alias("m"), F.col("c.place").alias("spot"))
    return found.filter("kind = 1").select(*columns).unionByName(of_shares)


def _possible(num: int, den: int) -> Column:
    """Length and positional filter for entries (n, place) and (m, spot) with the same n-gram.

    Of sets that have c in common, the first common n-gram has at most n - c before it in one and m - c in the other.
    """
    length = F.least("n", "m") * den >= F.greatest("n", "m") * num
    needed = overlap_needed(F.col("n"), F.col("m"), num, den)
    return length & (F.col("place") <= F.col("n") - needed) & (F.col("spot") <= F.col("m") - needed)


class _Verifier:
    """Checks pairs of nodes on their whole sets; a pair that was checked once is not checked again."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, num: int, den: int) -> None:
        self._docs, self._nodes, self._width, self._num, self._den = docs, nodes, width, num, den
        self._done: DataFrame | None = None

    def _sets(self, pairs: DataFrame) -> DataFrame:
        """Whole sets of the nodes that occur in pairs."""
        return self.sets_of(pairs.select(F.col("rep_a").alias("doc_id")).unionByName(pairs.select(F.col("rep_b").alias("doc_id"))).distinct())

    def sets_of(self, needed: DataFrame) -> DataFrame:
        """Whole sets of documents, made again from their texts."""
        width = self._width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces_of(batches, PIECE_BYTES):
                sets = [ngram_set(text, width).view(np.int64) for text in utf8(batch)]
                prints = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets], np.int64).reshape(-1, 2)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["f1", "f2", "grams"])

        wanted = self._docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(needed, "doc_id", "left_semi")
        return wanted.select("text").mapInArrow(run, "f1 long, f2 long, grams array<long>")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b) between nodes among candidate pairs (f1, f2, g1, g2)."""
        num, den = self._num, self._den
        ends = F.struct("f1", "f2"), F.struct(F.col("g1").alias("f1"), F.col("g2").alias("f2"))
        a, b = F.least(*ends), F.greatest(*ends)
        once = pairs.select(a["f1"].alias("f1"), a["f2"].alias("f2"), b["f1"].alias("g1"), b["f2"].alias("g2")).distinct()
        if self._done is not None:
            once = once.join(self._done, ["f1", "f2", "g1", "g2"], "left_anti")
        left = self._nodes.select("f1", "f2", F.col("n").alias("n_a"), F.col("ranges").alias("ranges_a"), F.col("rep").alias("rep_a"), F.col("node").alias("a"))
        right = self._nodes.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("n_b"), F.col("ranges").alias("ranges_b"), F.col("rep").alias("rep_b"), F.col("node").alias("b"))
        apart = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
        needed = overlap_needed(F.col("n_a"), F.col("n_b"), num, den)
        suffix = apart <= F.col("n_a") + F.col("n_b") - 2 * needed
        known = once.join(left, ["f1", "f2"]).join(right, ["g1", "g2"]).filter(suffix).drop("ranges_a", "ranges_b")
        known = stored(known, "candidates")
        done = known.select("f1", "f2", "g1", "g2")
        self._done = done if self._done is None else self._done.unionByName(done)
        sets = stored(self._sets(known), "sets")
        if sets.groupBy("f1", "f2").count().filter("count > 1").limit(1).collect():  # a text whose document id occurs twice may come twice
            sets = stored(sets.dropDuplicates(["f1", "f2"]), "sets")
        other = sets.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("grams").alias("grams_b"))
        both = known.join(sets, ["f1", "f2"]).join(other, ["g1", "g2"])
        common = F.size(F.array_intersect("grams", "grams_b"))
        similar = common * F.lit(den) >= (F.col("n_a") + F.col("n_b") - common) * F.lit(num)
        return stored(both.filter(similar).select("a", "b"), "verified")


def _remaining(buckets: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of buckets that still hold nodes of different components, with the component."""
    named = nodes.select("f1", "f2", "node").join(labels, "node", "left")
    named = named.select("f1", "f2", F.coalesce("component", "node").alias("component"))
    entries = buckets.drop("component").join(named, ["f1", "f2"])
    mixed = stored(entries.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("h"), "open-ngrams")
    return stored(entries.join(mixed.hint("merge"), "h", "left_semi"), "open-buckets")


def _star(entries: DataFrame, round_: int, num: int, den: int) -> DataFrame:
    """Each entry with the first node of its bucket and size class, if that is in another component."""
    placed = entries.withColumn("cls", _length_class(round_, num, den))
    centre = stored(placed.groupBy("h", "cls").agg(F.min(F.struct(*_FIRST, "n", "component")).alias("c")), "centres")
    pairs = placed.join(centre.hint("merge"), ["h", "cls"]).filter(F.col("component") != F.col("c.component"))
    return pairs.select("f1", "f2", "n", "place", F.col("c.f1").alias("g1"), F.col("c.f2").alias("g2"), F.col("c.n").alias("m"), F.col("c.place").alias("spot"))


def _all_pairs(entries: DataFrame) -> DataFrame:
    """All pairs of nodes with a common n-gram in different components.

    A pair is named by its first common n-gram, or nearly: where one of the few n-grams before is common too,
    it was named there. All common n-grams of such a pair are among the entries.
    """
    order = W.partitionBy("f1", "f2").orderBy("place")
    before = F.array_compact(F.array(*(F.lag("h", k).over(order) for k in range(1, 5))))
    entries = entries.withColumn("before", before)
    other = entries.select("h", F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("m"), F.col("place").alias("spot"), F.col("component").alias("c2"), F.col("before").alias("before_2"))
    return entries.join(other, "h").filter((F.col("component") < F.col("c2")) & ~F.arrays_overlap("before", "before_2"))


def _as_links(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b")


def common_ngrams(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many n-grams the sets at ``left`` and those at ``right`` have in common, as a matrix."""
    node = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, node = flat[order], node[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    sizes = np.diff(np.append(starts, len(flat)))
    row, col = np.full(len(sets), -1), np.full(len(sets), -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros(len(left) * len(right), np.int64)
    for d in range(2, RARE + 1):
        of = node[starts[sizes == d][:, None] + np.arange(d)]
        for a in range(d):
            for b in range(d):
                r, c = row[of[:, a]], col[of[:, b]]
                fine = (r >= 0) & (c >= 0)
                out += np.bincount(r[fine] * len(right) + c[fine], minlength=len(out))
    out = out.reshape(len(left), len(right))
    frequent = np.flatnonzero(sizes > RARE)
    column = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(frequent), COLUMNS):
        some = frequent[at : at + COLUMNS]
        place = np.full(len(sizes), -1)
        place[some] = np.arange(len(some))
        lo, hi = starts[some[0]], starts[some[-1]] + sizes[some[-1]]
        of, where = node[lo:hi], place[column[lo:hi]]
        of, where = of[where >= 0], where[where >= 0]
        has = np.zeros((len(sets), len(some)), np.float32)  # sums below 2^24 are exact
        has[of, where] = 1
        out += (has[left] @ has[right].T).astype(np.int64)
    return out


def _block_links(sets: list[np.ndarray], copies: np.ndarray, first: np.ndarray, whole: bool, num: int, den: int) -> np.ndarray:
    """Documents that each set links to: within one block, or between those of the first block and the others."""
    left, right = (np.arange(len(sets)),) * 2 if whole else (np.flatnonzero(first), np.flatnonzero(~first))
    links = np.zeros(len(sets), np.int64)
    if not (left.size and right.size):
        return links
    n = np.array(list(map(len, sets)), np.int64)
    common = common_ngrams(sets, left, right)
    linked = common * den >= (n[left][:, None] + n[right] - common) * num
    if whole:
        linked &= left[:, None] != right
        links += linked @ copies
    else:
        links[left] += linked @ copies[right]
        links[right] += linked.T @ copies[left]
    return links


def link_numbers(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """(f1, f2, links): documents of other nodes that a node links to. ``nodes`` have f1, f2, rep, n, copies and component; ``sets`` gives
    (f1, f2, grams) of nodes by their rep."""
    sizes = nodes.groupBy("component").agg(F.count("*").alias("n_nodes"), F.sum("n").alias("n_grams")).filter("n_nodes > 1")
    blocks = F.ceil(F.greatest(F.col("n_nodes") / BLOCK_NODES, F.col("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks")
    sizes = stored(sizes.select("component", blocks), "component-sizes")
    placed = nodes.join(sizes, "component").select("f1", "f2", "rep", "copies", "component", "blocks", F.pmod("f1", "blocks").cast("int").alias("own"))
    placed = stored(placed, "members")
    whole = stored(sets(placed.select("rep")).dropDuplicates(["f1", "f2"]), "member-sets")
    met = placed.drop("rep").join(whole, ["f1", "f2"]).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "f1", "f2", "copies", "grams")
    dealt = met.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def told(rows: list[tuple]) -> pa.RecordBatch:
            lo, hi = rows[0][1:3]
            first = np.array([r[3] == lo for r in rows])
            links = _block_links([r[7] for r in rows], np.array([r[6] for r in rows], np.int64), first, lo == hi, num, den)
            return pa.RecordBatch.from_arrays([pa.array([r[4] for r in rows]), pa.array([r[5] for r in rows]), pa.array(links)], names=["f1", "f2", "links"])

        for batch in batches:
            grams = batch.column("grams")
            cuts, flat = grams.offsets.to_numpy(), grams.values.to_numpy()
            # a copy, so that a batch is not held for one of its rows
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("component", "lo", "hi", "own", "f1", "f2", "copies")), strict=True)):
                if held and held[0][:3] != row[:3]:
                    yield told(held)
                    held = []
                held.append((*row, flat[cuts[k] : cuts[k + 1]].copy()))
        if held:
            yield told(held)
        trim()

    return dealt.mapInArrow(run, "f1 long, f2 long, links long").groupBy("f1", "f2").agg(F.sum("links").alias("links"))


def classes(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, counters: int = COUNTERS, bucket: int = BUCKET, count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, for links where den * common >= num * union; ``text_key`` is the xxhash64 of its text.

    With ``count_links`` also n_links, the number of other documents that it links to; copies count each.
    """
    spark = docs.sparkSession
    give_back(spark)
    signed = stored(signatures(docs, width, counters), "signatures")
    own = signed.filter("kind = 0")
    usable = own.filter("n > 0 AND doc_id IS NOT NULL")
    nodes = usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("ranges").alias("ranges"), F.count("*").alias("copies"))
    nodes = stored(nodes, "nodes")
    # a node goes by its smallest document id, unless that id has other texts too
    doubled = stored(nodes.groupBy("rep").count().filter("count > 1").select("rep", F.lit(True).alias("twice")), "doubled")
    surrogate = -1 - F.pmod("f1", F.lit(1 << 62))
    nodes = nodes.join(doubled, "rep", "left").withColumn("node", F.when(F.col("twice"), surrogate).otherwise(F.col("rep"))).drop("twice")
    usable_docs = docs.filter(F.col("doc_id").isNotNull())
    found = stored(shared_buckets(prefixes(usable_docs, width, num, den, frequencies(signed, counters), bucket), num, den), "buckets")
    buckets = found.filter("kind = 0").select("h", "f1", "f2", "n", "place")

    give_back(spark)
    verifier = _Verifier(usable_docs, nodes, width, num, den)
    links = verifier.links(_first_pairs(found).filter(_possible(num, den)))
    labels = components(links)
    give_back(spark)
    buckets = _remaining(buckets, nodes, labels)
    more = verifier.links(_star(buckets, 1, num, den).filter(_possible(num, den)))
    labels = components(_as_links(labels).unionByName(more))
    give_back(spark)
    rest = verifier.links(_all_pairs(_remaining(buckets, nodes, labels)).filter(_possible(num, den)))
    labels = components(_as_links(labels).unionByName(rest))

    named = nodes.select("f1", "f2", "rep", "node", "n", "copies").join(labels, "node", "left").select("f1", "f2", "rep", "n", "copies", F.coalesce("component", "node").alias("component"))
    if count_links:
        numbers = link_numbers(named, lambda reps: verifier.sets_of(reps.select(F.col("rep").alias("doc_id")).distinct()), num, den)
        copies = nodes.select("f1", "f2", "copies").join(numbers, ["f1", "f2"], "left").select("f1", "f2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    if doubled.take(1):
        smallest = stored(named.groupBy("component").agg(F.min("rep").alias("smallest")), "smallest-ids")
        named = named.join(smallest, "component").select("f1", "f2", F.col("smallest").alias("component"))
    named = named.select("f1", "f2", "component")
    out = own.select("doc_id", "text_key", "n", "f1", "f2").join(named, ["f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    shown = ["doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_key"]
    if not count_links:
        return out.select(*shown)
    known = F.when(F.col("doc_id").isNotNull(), F.col("n_links"))
    return out.join(stored(copies, "link-numbers"), ["f1", "f2"], "left").select(*shown, F.coalesce(known, F.lit(0)).alias("n_links"))
