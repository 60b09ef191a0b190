"""Alignment of two tokenizations of the same text, by a sweep over the events "a token ends here".

1. Every text is encoded by both vocabularies. The end events of both sides go
   into one table, as runs: (row, offset where the run begins, side, token ids).
   Both sides of a row are made where its text is read, so they carry the same
   key however the table is dealt or made again. Words that a worker has met
   are not encoded again.
2. Runs are dealt by document and sorted by offset within partitions. A sweep
   walks over them: where an end of A and an end of B fall together a group
   closes; between two neighbouring ends, of whichever side, exactly one token of
   A and one of B lie, and that is their link. Its state is the group that is
   open, a running hash and, for the document at hand, its different links.
3. The sweep numbers the different links (A id, B id) of some documents at a time
   in a dictionary, so that not every document's links have to travel: the
   dictionaries are summed to numbers of documents per link, the highest per A
   id is found, and both go back to the dictionaries.

Words are cut at single spaces before anything but white space, or before a run
of spaces at its first one: no token of A holds a space after another character,
no piece of B the sign for a space after another, so the parts do not depend on
each other. If the parts of B do not give back the text, the whole text is
encoded at once, and that result counts.

Defined cases: null and empty texts, and texts whose joined bytes of A or B are
not the text with a space before it, have no tokens: zeros and an empty digest;
repeated rows and rows with one id, or none, are documents of their own; very
long texts are several runs and go through the sweep piece by piece; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knitwork.llm.common import pieces_of, stored, texts, trim
from knitwork.llm.token_counts import _byte_letters

#: Tokens of a run, words whose tokens a worker keeps and the longest of them, and text bytes encoded at a time.
RUN, CACHE_WORDS, CACHED_LENGTH, PIECE_BYTES = 4096, 200_000, 60, 2_000_000
#: Links that share a dictionary, about: documents are added until there are so many. Tokens that the sweep works on at a time, about.
BLOCK_LINKS, AT_ONCE = 1_000_000, 400_000
A, B = 0, 1

_SPACE = "\u2581"
# White space in any of the definitions that tokenizers use; a word that begins with it stays with what is before.
_BLANK = r"\t\n\r\x0b\x0c\x1c-\x1f\x85\xa0" + "".join(map(chr, (0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)))
_BLANK_FIRST = re.compile(f"[{_BLANK}]")
_GLUED = re.compile(rf"\A | (?=[ {_BLANK}]|\Z)")
_BYTE = re.compile("<0x([0-9A-F]{2})>")


def words_of(text: str) -> list[str]:
    """Parts of " " + text without their leading space, each of which both sides encode by itself."""
    items = text.split(" ")
    if _GLUED.search(text) is None:
        return items
    out = [items[0]]
    for before, item in zip(items, items[1:], strict=False):
        if before and item and not _BLANK_FIRST.match(item):
            out.append(item)
        else:  # within a run of spaces, or before other white space
            out[-1] += " " + item
    return out


class Encoders:
    """Both vocabularies: ids of texts by words, and the bytes of every id."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True  # their strings in a text are ordinary text
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        names = {k: t for t, k in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        bytes_a = [bytes(letters[c] for c in names.get(k, "")) for k in range(max(names) + 1)]
        pieces = [self._b.id_to_piece(k) for k in range(self._b.get_piece_size())]
        bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(_SPACE, " ").encode() for p in pieces]
        self.bytes = (bytes_a, bytes_b)
        self._words: dict[str, tuple[bytes, bytes, bool]] = {}

    def _joined(self, side: int, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes[side].__getitem__, ids))

    def _encode(self, parts: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Ids of both sides, four bytes each, and whether both give back the text with a space before it."""
        ids_a = [e.ids for e in self._a.encode_batch([" " + p for p in parts], add_special_tokens=False)]
        ids_b = self._b.encode(parts, num_threads=1)
        out = []
        for part, a, b in zip(parts, ids_a, ids_b, strict=True):
            want = b" " + part.encode()
            fits = self._joined(A, a) == want and self._joined(B, b) == want
            out.append((np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes(), fits))
        return out

    def ids(self, batch: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides for every text, empty where they do not give back the text."""
        cut, known, none = [words_of(t) if t else [] for t in batch], self._words, np.zeros(0, np.int32)
        new = list(set().union(*cut).difference(known))
        for at in range(0, len(new), 20_000):
            known.update(zip(new[at : at + 20_000], self._encode(new[at : at + 20_000]), strict=True))
        out = []
        for text, words in zip(batch, cut, strict=True):
            if not text:
                out.append((none, none))
                continue
            a, b, fits = zip(*map(known.__getitem__, words), strict=True)
            if not all(fits):
                (whole,) = self._encode([text])
                a, b = ((whole[0],), (whole[1],)) if whole[2] else ((), ())
            out.append((np.frombuffer(b"".join(a), np.int32), np.frombuffer(b"".join(b), np.int32)))
        over = len(known) - CACHE_WORDS
        for w in new if over > 0 else [x for x in new if len(x) > CACHED_LENGTH]:
            del known[w]
        return out


@lru_cache(maxsize=1)
def _encoders(path_a: str, path_b: str) -> Encoders:
    """One per worker process, shared by its tasks."""
    return Encoders(path_a, path_b)


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")


def end_events(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, run: int = RUN) -> DataFrame:
    """Runs of end events of both sides: row, doc_id, offset (bytes before the run), side and ids (two bytes each).

    A document has a run of side A at offset 0 in any case, empty if it has no tokens.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(*_paths(path_a, path_b))
        sizes = [np.array(list(map(len, b)), np.int64) for b in encoders.bytes]
        for batch in pieces_of(batches, PIECE_BYTES):
            out: list[tuple] = []
            for row, doc, both in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), encoders.ids(texts(batch)), strict=True):
                for side, ids in enumerate(both):
                    if len(ids) <= run:
                        if side == A or len(ids):
                            out.append((row, doc, 0, side, ids.astype(np.uint16).tobytes()))
                        continue
                    ends = np.cumsum(sizes[side][ids])
                    for at in range(0, len(ids), run):
                        out.append((row, doc, int(ends[at - 1]) if at else 0, side, ids[at : at + run].astype(np.uint16).tobytes()))
            cols, kinds = list(zip(*out, strict=True)) or [()] * 5, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["row", "doc_id", "offset", "side", "ids"])
        trim()

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(encode, "row long, doc_id long, offset long, side int, ids binary")


def swept(events: DataFrame) -> DataFrame:
    """Events dealt by document and sorted by offset, as the sweep takes them."""
    return events.repartition("row").sortWithinPartitions("row", "offset", "side")


class _Open:
    """What the sweep knows of the document that it is in: tokens not yet in a closed group, counts, the running hash, links so far."""

    def __init__(self, row: int, doc: int | None) -> None:
        self.row, self.doc, self.base = row, doc, 0
        self.rest = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.new: list[list[np.ndarray]] = [[], []]
        self.counts = np.zeros(4, np.int64)  # tokens of A, of B, groups, links
        self.digest = hashlib.sha256()
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def gather(self) -> None:
        """Put what has arrived behind what is not yet in a group."""
        for side, new in enumerate(self.new):
            if new:
                self.rest[side] = np.concatenate([self.rest[side], *new])
        self.new = [[], []]


class Sweep:
    """Consumes sorted runs and closes groups. ``tell``, if given, gets all links of a document as they are found: the document, the groups'
    numbers, ids of A and of B, and the first and last end of the bytes that they share."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes], tell: Callable[..., None] | None = None) -> None:
        self._tell = tell
        self.sizes = [np.array(list(map(len, b)), np.int64) for b in (bytes_a, bytes_b)]
        self.n_b = len(bytes_b)
        # decimal ids with what follows them: "," within a side, "|" or ";" at its end; zero bytes are left out
        self._digits = [np.stack([self._table(len(b), x) for x in ends], 1) for b, ends in ((bytes_a, ",|"), (bytes_b, ",;"))]

    @staticmethod
    def _table(n: int, end: str) -> np.ndarray:
        return np.frombuffer(b"".join(f"{k}{end}".encode().ljust(6, b"\0") for k in range(n)), np.uint8).reshape(n, 6)

    def close(self, ids_a: np.ndarray, ids_b: np.ndarray, whole: bool) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Tokens of both sides up to the last common end, all if the document is whole, and where they end."""
        ends_a, ends_b = np.cumsum(self.sizes[A][ids_a]), np.cumsum(self.sizes[B][ids_b])
        n_a, n_b = len(ids_a), len(ids_b)
        if not whole:
            at = np.searchsorted(ends_b, ends_a)
            common = np.flatnonzero(np.append(ends_b, -1)[at] == ends_a)
            n_a, n_b = (int(common[-1]) + 1, int(at[common[-1]]) + 1) if common.size else (0, 0)
        return n_a, n_b, ends_a[:n_a], ends_b[:n_b]

    @staticmethod
    def pairs(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, ...]:
        """For closed groups: the end of every link, the places of its tokens of A and of B, and which tokens of A and of B end a group."""
        size = int(ends_a[-1]) + 1
        mark_a, mark_b = np.zeros(size, bool), np.zeros(size, bool)
        mark_a[ends_a], mark_b[ends_b] = True, True
        ends = np.flatnonzero(mark_a | mark_b)
        # as many tokens end before as the place of the one that covers the stretch up to this end
        token_a = np.cumsum(mark_a, dtype=np.int32)[ends] - mark_a[ends]
        token_b = np.cumsum(mark_b, dtype=np.int32)[ends] - mark_b[ends]
        return ends, token_a, token_b, mark_b[ends_a], mark_a[ends_b]

    def listing(self, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> np.ndarray:
        """``a1,a2|b1;`` of all groups in order, six bytes a token, zeros where it needs fewer."""
        group_a, group_b = (np.cumsum(x, dtype=np.int32) - x for x in (last_a, last_b))
        groups = int(last_a.sum())
        through_a, through_b = (np.cumsum(np.bincount(x, minlength=groups)) for x in (group_a, group_b))
        out = np.zeros((len(ids_a) + len(ids_b), 6), np.uint8)
        out[np.arange(len(ids_a)) + np.append(0, through_b)[group_a]] = self._digits[A][ids_a, last_a.astype(np.int8)]
        out[np.arange(len(ids_b)) + through_a[group_b]] = self._digits[B][ids_b, last_b.astype(np.int8)]
        return out

    def take(self, docs: list[tuple[_Open, bool]]) -> None:
        """Close what can be closed of several documents at once. With each comes whether all of its tokens are there."""
        for d, _ in docs:
            d.gather()
        parts = [(d, *self.close(*d.rest, whole)) for d, whole in docs]
        if not (parts := [p for p in parts if p[1]]):
            return
        ids_a, ids_b = (np.concatenate([p[0].rest[side][: p[1 + side]] for p in parts]) for side in (A, B))
        counts_a, counts_b, lengths = (np.array(x) for x in zip(*((a, b, int(e[-1])) for _, a, b, e, _ in parts), strict=True))
        bases = np.cumsum(lengths) - lengths
        ends_a, ends_b = (np.concatenate([p[k] for p in parts]) + np.repeat(bases, n) for k, n in ((3, counts_a), (4, counts_b)))
        ends, token_a, token_b, last_a, last_b = self.pairs(ends_a, ends_b)
        cuts_a, cuts_b = np.append(0, np.cumsum(counts_a)), np.append(0, np.cumsum(counts_b))
        of_link = np.searchsorted(bases, ends) - 1
        link_cuts = np.searchsorted(of_link, np.arange(len(parts) + 1))
        listing = self.listing(ids_a, ids_b, last_a, last_b)
        different, times = np.unique(of_link << 32 | ids_a[token_a] * self.n_b + ids_b[token_b], return_counts=True)
        cuts = np.searchsorted(different, np.arange(len(parts) + 1) << 32)
        group = np.cumsum(last_a) - last_a
        for k, (d, n_a, n_b, *_) in enumerate(parts):
            if self._tell is not None:
                own = slice(link_cuts[k], link_cuts[k + 1])
                until = ends[own] - bases[k] + d.base
                since = np.append(d.base, until[:-1])
                numbers = group[token_a[own]] - group[cuts_a[k]] + d.counts[2]
                self._tell(d, numbers, ids_a[token_a[own]], ids_b[token_b[own]], since, until)
            own = listing[cuts_a[k] + cuts_b[k] : cuts_a[k + 1] + cuts_b[k + 1]].ravel()
            d.digest.update(b";" * bool(d.counts[2]) + own[own != 0].tobytes()[:-1])
            d.counts += (n_a, n_b, last_a[cuts_a[k] : cuts_a[k + 1]].sum(), link_cuts[k + 1] - link_cuts[k])
            d.links.append((different[cuts[k] : cuts[k + 1]] & 0xFFFFFFFF, times[cuts[k] : cuts[k + 1]]))
            d.rest = [d.rest[A][n_a:], d.rest[B][n_b:]]
            d.base += int(lengths[k])
            if len(d.links) > 8:
                d.links = [merged(d.links)]

    def documents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[_Open]]:
        """Finished documents, some at a time. The last one stays open until another begins."""
        held: _Open | None = None
        for batch in batches:
            rows, sides, ids, names = (batch.column(c).to_pylist() for c in ("row", "side", "ids", "doc_id"))
            seen, size = [] if held is None else [held], 0
            for row, side, own, name in zip(rows, sides, ids, names, strict=True):
                if held is None or held.row != row:
                    if size > AT_ONCE:
                        self.take([(d, True) for d in seen])
                        yield seen
                        seen, size = [], 0
                    held = _Open(row, name)
                    seen.append(held)
                elif size > AT_ONCE:
                    self.take([(d, d is not held) for d in seen])
                    yield seen[:-1]
                    seen, size = [held], 0
                held.new[side].append(np.frombuffer(own, np.uint16).astype(np.int64))
                size += len(own) // 2
            if seen:
                self.take([(d, d is not held) for d in seen])
                yield seen[:-1]
        if held is not None:
            self.take([(held, True)])
            yield [held]


def merged(links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different links and how often they occur, of several such lists."""
    if len(links) == 1:
        return links[0]
    pairs, times = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, np.int64) for k in (0, 1))
    different, where = np.unique(pairs, return_inverse=True)
    return different, np.bincount(where, weights=times, minlength=len(different)).astype(np.int64)


_SWEPT = "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, times binary, pair long, place int, n long"


def sweep(events: DataFrame, path_a: str | None = None, path_b: str | None = None, block_links: int = BLOCK_LINKS) -> DataFrame:
    """kind 0: a row per document with its counts, digest and different links (places in the dictionary of its block) with how often each
    occurs; kind 1: the dictionaries, a row per block and different link with the number of its documents that hold it."""
    names = [c.split()[0] for c in _SWEPT.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[c.split()[1]] for c in _SWEPT.split(", ")]

    def block_rows(docs: list[tuple], block: int) -> Iterator[pa.RecordBatch]:
        lists = [d[6] for d in docs]
        flat = np.concatenate([x[0] for x in lists])
        different, where, n = np.unique(flat, return_inverse=True, return_counts=True)
        where, times = where.astype(np.int32), np.concatenate([x[1] for x in lists]).astype(np.int32)
        cuts = np.cumsum([0, *(len(x[0]) for x in lists)])
        rows = [(0, block, *d[:6], where[a:b].tobytes(), times[a:b].tobytes()) for d, a, b in zip(docs, cuts, cuts[1:], strict=False)]
        cols = [*zip(*rows, strict=True), *[[None] * len(rows)] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        for at in range(0, len(different), 100_000):
            own = different[at : at + 100_000]
            size = len(own)
            fixed = [pa.array(np.full(size, 1, np.int32)), pa.array(np.full(size, block)), *(pa.nulls(size, k) for k in kinds[2:10])]
            fixed += [pa.array(own), pa.array(np.arange(at, at + size, dtype=np.int32)), pa.array(n[at : at + size])]
            yield pa.RecordBatch.from_arrays(fixed, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Sweep(*_encoders(*_paths(path_a, path_b)).bytes)
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for finished in machine.documents(batches):
            for d in finished:
                links = merged(d.links)
                held.append((d.doc, *d.counts.tolist(), d.digest.hexdigest() if d.counts[0] else "", links))
                size += int(len(links[0])) + 1
                d.links = []
            if size >= block_links:
                yield from block_rows(held, block)
                block, held, size = block + 1, [], 0
        if held:
            yield from block_rows(held, block)
        trim()

    return events.mapInArrow(run, _SWEPT)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, run: int = RUN, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Per document: tokens of both sides, groups, links, links that are the most frequent of their A id, the sum of the links' numbers of
    documents, and the SHA-256 of the groups."""
    found = stored(sweep(swept(end_events(docs, path_a, path_b, run)), path_a, path_b, block_links), "swept")
    dictionary = found.filter("kind = 1").select("block", "place", "pair", "n")
    n_b = len(_encoders(*_paths(path_a, path_b)).bytes[B])
    counts = dictionary.groupBy("pair").agg(F.sum("n").alias("count"))
    # the links of one A id are at most as many as there are ids of B
    highest = F.max("count").over(W.partitionBy(F.floor(F.col("pair") / n_b)))
    counts = stored(counts.select("pair", "count", (F.col("count") == highest).alias("best")), "link-counts")
    known = dictionary.join(counts, "pair").select(F.col("block").alias("of_block"), "place", "count", "best")
    of_docs = found.filter("kind = 0").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def add_up(docs: pa.Table, words: pa.Table) -> pa.Table:
        place = words.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        count[place], best[place] = words.column("count").to_numpy(), words.column("best").to_numpy()
        n_best, total = [], []
        for links, times in zip(docs.column("links").to_pylist(), docs.column("times").to_pylist(), strict=True):
            links, times = np.frombuffer(links, np.int32), np.frombuffer(times, np.int32).astype(np.int64)
            n_best.append(int(times[best[links]].sum()))
            total.append(int((times * count[links]).sum()))
        out = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        names = [c.split()[0] for c in schema.split(", ")]
        return pa.table({c: out[c] if c in out else docs.column(c) for c in names})

    return of_docs.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(add_up, schema)


def links(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, run: int = RUN) -> DataFrame:
    """A row per link: row, doc_id, group number, a_id, b_id and the stretch of bytes (of the text with a space before it) that both tokens cover."""

    names = ["row", "doc_id", "group", "a_id", "b_id", "start", "end"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[tuple] = []
        tell = lambda d, *columns: told.append((np.full(len(columns[0]), d.row), [d.doc] * len(columns[0]), *columns))
        machine = Sweep(*_encoders(*_paths(path_a, path_b)).bytes, tell)
        for _ in machine.documents(batches):
            while told:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in told.pop(0)], names=names)

    events = swept(end_events(docs, path_a, path_b, run))
    return events.mapInArrow(walk, "row long, doc_id long, group long, a_id long, b_id long, start long, end long")
