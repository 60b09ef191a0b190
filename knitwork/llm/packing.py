"""Packing token streams into fixed-length training sequences.

First-fit decreasing with a tournament tree over the free room of the bins, run
independently in randomised groups of pieces, so that no group grows with the
corpus.

Defined cases: a null or empty text is one end-of-text id; documents longer than
a sequence are cut at multiples of the capacity; repeated rows and null ids are
packed once per row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import contextlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitwork.llm.common import stored, texts, trim

CAPACITY = 4096
END_ID = 2
#: Pieces in a randomised group; about half a sequence per group stays open.
GROUP_PIECES = 2048
#: Distinct words whose ids a worker keeps.
CACHE_WORDS = 800_000

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_MARKS = ".,;:!?%*#&$@=+/|\\()[]{}<>~^`\"_-"
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: Letters that stay one letter when lowered and composed, so that marks after them begin a token of their own. Others may not: capital
#: I with a dot becomes two characters, of which the second joins the marks.
_SIMPLE_LETTERS = frozenset(chr(c) for c in range(256) if chr(c).isalpha())


class WordIds:
    """Token ids of whole texts by way of their words.

    The vocabulary drops white space and never merges across it, so the ids of a
    text are those of its words in order. The library encodes each distinct word
    once. The first ``most`` words stay known, which are mostly the common
    ones; later ones are encoded wherever they occur.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_padding()
        self._library.no_truncation()
        self._known: dict[str, bytes] = {}
        self._most = most

    def words(self, text: str) -> list[str]:
        if "<|" not in text:  # special strings are looked for before letters are lowered
            with contextlib.suppress(UnicodeEncodeError):
                text.encode("latin-1")  # here str.lower lowers as the library does
                text = text.lower()
        # str.split also splits at the four separators below, which are not white space to the library
        return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()

    def _by_library(self, words: list[str]) -> list[bytes]:
        got = self._library.encode_batch_fast(words, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (x.ids for x in got)]

    def _missing(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words not yet known. Marks that follow a simple letter are a token run of their own, so both parts are looked up."""
        known, parts, need = self._known, {}, set()
        for w in words:
            stem = w.rstrip(_MARKS)
            if stem and len(stem) < len(w) and stem[-1] in _SIMPLE_LETTERS and "<|" not in w:
                parts[w] = stem, w[len(stem) :]
                need.update(x for x in parts[w] if x not in known)
            else:
                need.add(w)
        need = list(need)
        fresh = dict(zip(need, self._by_library(need), strict=True)) if need else {}
        out = fresh | {w: b"".join(fresh[x] if x in fresh else known[x] for x in halves) for w, halves in parts.items()}
        if len(known) < self._most:
            known.update(out)
        return out

    def encode(self, batch: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known = self._known
        for text in batch:
            words = self.words(text)
            found = list(map(known.get, words))
            if None in found:
                fresh = self._missing({w for w, ids in zip(words, found, strict=True) if ids is None})
                found = [fresh[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
            yield b"".join(found)


@lru_cache(maxsize=2)
def _encoder(path: str, most: int) -> WordIds:
    """One per worker process, shared by its tasks."""
    return WordIds(path, most)


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, cache_words: int = CACHE_WORDS, keep: bool = True) -> DataFrame:
    """Token pieces of at most ``capacity`` ids: one row per piece, with the checksum of its ids. Without ``keep`` a worker forgets its words after each task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        encoder = _encoder(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), cache_words)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for salt, (doc, ids) in enumerate(zip(batch.column("doc_id").to_pylist(), encoder.encode(texts(batch)), strict=True)):
                ids += end
                total = len(ids) // 4
                out += [(doc, at, min(capacity, total - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]), total, salt) for at in range(0, total, capacity)]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])
        if not keep:
            del encoder
            _encoder.cache_clear()
            trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


class RoomTree:
    """Tournament tree over the free room of bins: finds the first bin with enough room in O(log n)."""

    def __init__(self, bins: int, capacity: int) -> None:
        self._leaves = 1 << max(0, (bins - 1).bit_length())
        self._room = [capacity] * (2 * self._leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Index of the first bin with room for ``length``, and that bin's room before."""
        room, node = self._room, 1
        while node < self._leaves:
            node *= 2
            if room[node] < length:
                node += 1
        before = room[node]
        room[node] = before - length
        leaf, node = node - self._leaves, node // 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
        return leaf, before


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; ties keep the given order."""
    tree = RoomTree(len(lengths), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable"):
        bins[k], room = tree.place(int(lengths[k]))
        offsets[k] = capacity - room
    return bins, offsets


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Sequences for a stored table of pieces; ``sequence_id`` holds the group in its upper half."""
    groups = max(1, math.ceil(cut.count() / group_pieces))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "salt")])
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        first = table.column("grp")[0].as_py() << 32
        kept = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return kept.append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))

    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(groups)).cast("long")
    return cut.withColumn("grp", group).groupBy("grp").applyInArrow(fit, _PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, cache_words: int = CACHE_WORDS, keep: bool = True) -> DataFrame:
    """Tokenise once, keep only the small piece rows, and pack those. ``cache_words`` and ``keep`` trade a worker's memory for time."""
    return pack(stored(pieces(docs, tokenizer_path, capacity, cache_words, keep), "pieces"), capacity)
