"""Exact token counts at every prefix of a text, by dynamic programming.

For each character position i the operator knows how many tokens the library
would give for ``text[:i]``. These counts are stored for every text, so that
truncation and budget questions need neither the text nor its encoding again: a
count every few characters, and a byte for each character with what is to be
added, about 1.1 bytes a character before compression. Within a pre-token the last token of every prefix is found from the
last tokens of shorter prefixes: a byte-pair encoding is the encoding of a text
exactly when each two neighbouring tokens are the encoding of their own
concatenation, and only one last token of a prefix satisfies that. All new words
of a batch of texts take each step of this together, in arrays.

Prefix counts need not be monotone: a longer prefix can merge into fewer tokens.

Defined cases: null counts as empty (0 tokens); the special string inside a text
is one token; very long words are handled in linear time; repeated rows and null
ids give one row per row; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knitwork.llm.common import stored, texts

LIMIT = 1024
#: Distinct chunks whose prefix counts a worker keeps, and the longest chunk kept.
CACHE_CHUNKS, CACHED_LENGTH = 1_000_000, 80
#: Most bytes of a pre-token that is counted together with others, how many are at a time, and how few are better counted one by one.
TOGETHER, AT_ONCE, FEW = 32, 20_000, 200
#: Characters that share a stored count, to which bytes are added; texts whose counts differ by more than a byte holds share fewer.
SHARED_BY = 32
#: Slots, as a power of two, for what is known of pairs of tokens; they are forgotten when half of the slots are taken.
PAIR_BITS = 21

_CHUNK = re.compile(r" ?[^ \n]+|[ \n]")
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_SHORTENED = {"'re", "'ve", "'ll"}


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(moved)}


class _Table:
    """Numbers from 0 by numbers from 0, looked up and added as arrays: open addressing, at most half full."""

    def __init__(self, bits: int) -> None:
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values, self.held = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of int64 keys, -1 where there is none."""
        slots = self._slots(keys)
        there = self._keys[slots]
        out = np.where(there == keys, self._values[slots], np.int32(-1))
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while rest.size:
            slots[rest] = (slots[rest] + 1) & self._mask
            there, wanted = self._keys[slots[rest]], keys[rest]
            out[rest[there == wanted]] = self._values[slots[rest[there == wanted]]]
            rest = rest[(there != wanted) & (there >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table yet."""
        self.held += keys.size
        slots = self._slots(keys)
        while keys.size:
            free = self._keys[slots] < 0
            self._keys[slots[free]] = keys[free]
            put = self._keys[slots] == keys  # of several for one slot the last got it
            self._values[slots[put]] = values[put]
            keys, values, slots = keys[~put], values[~put], (slots[~put] + 1) & self._mask

    def clear(self) -> None:
        self._keys.fill(-1)
        self.held = 0


class PrefixCounter:
    """Prefix token counts for a byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self._special = [t["content"] for t in spec["added_tokens"]]
        self._vocab = {to_bytes(t) for t in spec["model"]["vocab"] if t not in self._special}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self._ranks = {(to_bytes(a), to_bytes(b)): k for k, (a, b) in enumerate(merges)}
        self._longest = max(map(len, self._vocab))
        self._split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._chunks: dict[str, bytes] = {}
        self._marks = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None
        self._tokens = [b"", *sorted(self._vocab)]
        self._grow_trie()
        self._fits = _Table(PAIR_BITS)

    def _grow_trie(self) -> None:
        """Nodes by parent and byte; the token (its place in ``_tokens``) that ends at each node, or 0."""
        nodes, token = {b"": 0}, [0]
        for number, t in enumerate(self._tokens[1:], 1):
            for k in range(1, len(t) + 1):
                if t[:k] not in nodes:
                    nodes[t[:k]] = len(token)
                    token.append(0)
            token[nodes[t]] = number
        keys = np.fromiter((nodes[t[:-1]] << 8 | t[-1] for t in nodes if t), np.int64, len(nodes) - 1)
        self._trie = _Table(max(20, keys.size.bit_length() + 1))
        self._trie.add(keys, np.arange(1, len(nodes), dtype=np.int32))
        self._ends = np.array(token, np.int32)

    def _merge(self, data: bytes) -> list[bytes]:
        """Plain BPE of a short byte string."""
        parts, rank_of, none = [data[k : k + 1] for k in range(len(data))], self._ranks.get, 1 << 30
        ranks = [rank_of(pair, none) for pair in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (rank := min(ranks)) != none:
            at = ranks.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = rank_of((parts[at], parts[at + 1]), none)
        return parts

    def _joins(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens stay as they are side by side; with nothing on the left, whether the token encodes its own bytes."""
        if len(self._pairs) > 1_000_000:
            self._pairs.clear()
        known = self._pairs[left, right] = self._merge(left + right) == ([left, right] if left else [right])
        return known

    def byte_prefixes(self, data: bytes) -> list[int]:
        """Token count of ``data[:k]`` for k = 0 ... len(data), for one pre-token."""
        last, count, vocab, pairs, longest = [b""], [0], self._vocab, self._pairs, self._longest
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = data[start:end]
                if token in vocab:
                    fits = pairs.get((last[start], token))
                    if self._joins(last[start], token) if fits is None else fits:
                        last.append(token)
                        count.append(count[start] + 1)
                        break
            else:
                raise ValueError(f"no encoding of {data[:end]!r}")
        return count

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """As ``_joins``, for pairs of places in ``_tokens``."""
        codes = left.astype(np.int64) * len(self._tokens) + right
        fits = self._fits.get(codes)
        if (unknown := fits < 0).any():
            new, where = np.unique(codes[unknown], return_inverse=True)
            pairs = [(self._tokens[c // len(self._tokens)], self._tokens[c % len(self._tokens)]) for c in new.tolist()]
            found = np.fromiter((self._merge(a + b) == ([a, b] if a else [b]) for a, b in pairs), np.int32, new.size)
            fits[unknown] = found[where]
            if self._fits.held + new.size > 1 << (PAIR_BITS - 1):
                self._fits.clear()
            self._fits.add(new[: 1 << (PAIR_BITS - 1)], found[: 1 << (PAIR_BITS - 1)])
        return fits == 1

    def _together(self, pieces: list[str]) -> list[bytes]:
        """For each pre-token, of at most ``TOGETHER`` bytes, the token counts of ``piece[:k]`` for k = 1 ... len(piece), a byte each."""
        data = np.frombuffer("".join(pieces).encode(), np.uint8)
        n_chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
        char_starts = np.flatnonzero(data & 0xC0 != 0x80)
        char_ends, char_cuts = np.append(char_starts[1:], data.size), np.cumsum(n_chars)
        ends = char_ends[char_cuts - 1]
        starts = np.append(0, ends[:-1])
        word = np.repeat(np.arange(ends.size), ends - starts)
        at = np.arange(data.size)
        left, offset, found = ends[word] - at, at - starts[word], []
        node = np.zeros(data.size, np.int64)
        for length in range(1, TOGETHER + 1):  # all tokens that begin at each byte
            node = self._trie.get(node << 8 | data[at + (length - 1)])
            at, node = at[node >= 0], node[node >= 0].astype(np.int64)
            token = self._ends[node]
            begin = at[token > 0]
            found.append((begin, token[token > 0], ((offset[begin] + length) << 6 | (63 - length)).astype(np.uint16)))
            more = left[at] > length
            at, node = at[more], node[more]
            if not at.size:
                break
        begin, token, turn = (np.concatenate(x) for x in zip(*found, strict=True))
        # by length of the prefix, then the longest token first
        order = np.argsort(turn, kind="stable")
        begin, token, turn = begin[order], token[order], turn[order]
        cuts = np.flatnonzero(np.diff(turn, prepend=0, append=0))
        # the prefix of word w that ends before byte p is at p + w; the empty one has 0 as its last token
        last, count = np.full(data.size + ends.size, -1, np.int32), np.zeros(data.size + ends.size, np.uint8)
        last[starts + np.arange(ends.size)] = 0
        before = begin + word[begin]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            length = 63 - (int(turn[lo]) & 63)
            free = np.flatnonzero(last[before[lo:hi] + length] < 0) + lo
            fit = free[self._joined(last[before[free]], token[free])]
            last[before[fit] + length] = token[fit]
            count[before[fit] + length] = count[before[fit]] + 1
        if (last < 0).any():
            raise ValueError(f"no encoding of one of {pieces[:3]!r} ...")
        flat, cuts = count[char_ends + word[char_starts]].tobytes(), [0, *char_cuts.tolist()]
        got = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return [bytes([g[0], 2, g[2]]) if piece in _SHORTENED else g for piece, g in zip(pieces, got, strict=True)]

    def _fragment(self, piece: str) -> list[int]:
        """Token count of ``piece[:k]`` for k = 1 ... len(piece), where piece is one pre-token."""
        counts = self.byte_prefixes(piece.encode())
        if len(counts) != len(piece) + 1:
            ends = np.cumsum([len(c.encode()) for c in piece])
            return [counts[e] for e in ends]
        if piece in _SHORTENED:  # cut after its second letter, it is a mark and a letter
            counts[2] = 2
        return counts[1:]

    def _pieces(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk."""
        core = chunk[chunk[0] == " " :]
        if core.isalpha() and max(core) < "\u0250":
            return [chunk]
        if chunk[-1] in ",." and core[:-1].isalpha() and max(core) < "\u0250":
            return [chunk[:-1], chunk[-1]]
        return [chunk[start:end] for _, (start, end) in self._split(chunk)]

    def _alone(self, chunk: str) -> np.ndarray:
        """Prefix counts 1 ... len(chunk) of a chunk that is not kept."""
        counts, base = [], 0
        for p in self._pieces(chunk):
            own = np.array(self._fragment(p), np.int32) + base
            counts.append(own)
            base = int(own[-1])
        return np.concatenate(counts)

    @staticmethod
    def _odd(text: str) -> bool:
        """Whether there may be pre-tokens of white space that depend on what follows them."""
        return "  " in text or " \n" in text or "\n " in text or "\n\n" in text or _ODD.search(text) is not None

    def chunks_of(self, text: str) -> list[str] | None:
        """Parts of a text whose tokens do not depend on each other: words, or all pre-tokens if white space is odd; None with special strings."""
        if self._marks is not None and any(s in text for s in self._special):
            return None
        return [text[start:end] for _, (start, end) in self._split(text)] if self._odd(text) else _CHUNK.findall(text)

    def learn(self, lists: Iterable[list[str] | None]) -> list[str]:
        """Count the chunks that are not known yet, all of them together; returns them. Very long ones are left out."""
        known = self._chunks
        new = {c: self._pieces(c) for c in set().union(*filter(None, lists)).difference(known) if len(c) <= CACHED_LENGTH}
        own: dict[str, bytes] = {}
        short = []
        for p in set().union(*new.values()):
            if p in known:  # a chunk that is one pre-token
                own[p] = known[p]
            elif len(p) <= TOGETHER and len(p.encode()) <= TOGETHER:
                short.append(p)
            elif max(counts := self._fragment(p)) < 256:
                own[p] = bytes(counts)
        if len(short) < FEW:
            own.update((p, bytes(self._fragment(p))) for p in short)
        else:
            for k in range(0, len(short), AT_ONCE):
                own.update(zip(short[k : k + AT_ONCE], self._together(short[k : k + AT_ONCE]), strict=True))
        for c, ps in new.items():
            counts, base = [], 0
            for p in ps:
                if (of_piece := own.get(p)) is None:
                    break
                counts += [base + n for n in of_piece] if base else of_piece
                base += of_piece[-1]
            else:
                if max(counts) < 256:
                    known[c] = bytes(counts)
        return list(new)

    def forget(self, chunks: list[str]) -> None:
        """Drop chunks that were just learned if there are too many."""
        if len(self._chunks) > CACHE_CHUNKS:
            for c in chunks:
                self._chunks.pop(c, None)

    def prefixes(self, text: str, chunks: list[str] | None = None) -> np.ndarray:
        """Token counts of ``text[:i]`` for i = 0 ... len(text); chunks: those of the text, if they are at hand."""
        if not text:
            return np.zeros(1, np.int32)
        if chunks is None and (chunks := self.chunks_of(text)) is None:
            return self._with_special(text)
        new = self.learn([chunks])
        parts = list(map(self._chunks.get, chunks))
        self.forget(new)
        if None in parts:
            parts = [self._alone(c) if p is None else np.frombuffer(p, np.uint8) for c, p in zip(chunks, parts, strict=True)]
            own = np.concatenate(parts)
        else:
            own = np.frombuffer(b"".join(parts), np.uint8)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths)
        before = np.cumsum(own[ends - 1], dtype=np.int64) - own[ends - 1]
        out = np.zeros(len(text) + 1, np.int32)
        out[1:] = own + np.repeat(before, lengths)
        if self._odd(text):
            # of a run of white space the last one goes with the next word; a prefix that ends there keeps the run whole
            for k, (run, c) in enumerate(zip(chunks, chunks[1:], strict=False)):
                if c[0].isspace() and run.isspace():
                    out[ends[k] + 1] = before[k] + self._fragment(run + c[0])[-1]
        return out

    def _with_special(self, text: str) -> np.ndarray:
        out, base = [np.zeros(1, np.int32)], 0
        parts = self._marks.split(text)
        for plain, mark in zip(parts[::2], [*parts[1::2], ""], strict=True):
            # short of its last letter the special string is ordinary text that may join what precedes it
            own = self.prefixes(plain + mark[:-1])[1:] + base
            base += int(self.prefixes(plain)[-1])
            out.append(own)
            if mark:
                base += 1
                out.append(np.array([base], np.int32))
        return np.concatenate(out)


@lru_cache(maxsize=2)
def _counter(path: str) -> PrefixCounter:
    """One per worker process, shared by its tasks."""
    return PrefixCounter(path)


def longest_within(prefixes: np.ndarray, budget: int) -> int:
    """Most characters that can be kept within ``budget`` tokens."""
    return int(np.flatnonzero(prefixes <= budget)[-1])


def packed(counts: np.ndarray) -> tuple[int, bytes, bytes]:
    """Counts as (characters that share one, shared counts, what is to be added for each character)."""
    share, n = SHARED_BY, len(counts)
    while True:
        rows = np.pad(counts, (0, -n % share), "edge").reshape(-1, share)
        shared = rows.min(1)
        more = rows - shared[:, None]
        if more.max() < 256:
            return share, shared.astype(np.int32).tobytes(), more.ravel()[:n].astype(np.uint8).tobytes()
        share //= 2  # one character at most adds its own count to nothing


def unpacked(share: int, shared: bytes, more: bytes) -> np.ndarray:
    """The counts at all prefixes, from the empty one to the whole text."""
    out = np.frombuffer(more, np.uint8).astype(np.int32)
    return out + np.repeat(np.frombuffer(shared, np.int32), share)[: len(out)]


_TABLE = "doc_id long, n_bytes long, share int, shared binary, more binary"


def prefix_table(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """The stored table: per document its bytes and, packed, the token count at every prefix. Written; texts are not needed afterwards."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counter = _counter(tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"))
        for batch in batches:
            ids, whole, out = batch.column("doc_id").to_pylist(), texts(batch), []
            cut = [counter.chunks_of(t) for t in whole]
            new = counter.learn(cut)
            for doc, text, chunks in zip(ids, whole, cut, strict=True):
                out.append((doc, len(text.encode()), *packed(counter.prefixes(text, chunks))))
            counter.forget(new)
            cols, kinds = list(zip(*out, strict=True)) or [()] * 5, [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _TABLE.split(", ")])

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, _TABLE), "prefix-counts")


def within(table: DataFrame, budget: int = LIMIT, keep_prefixes: bool = False) -> DataFrame:
    """From a stored table: bytes, tokens, most characters that fit the budget, and on request the count at every prefix."""
    schema = "doc_id long, n_bytes long, n_tokens long, n_chars_within long" + (", prefix_tokens array<int>" if keep_prefixes else "")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            out = []
            for doc, n_bytes, *own in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                counts = unpacked(*own)
                out.append((doc, n_bytes, int(counts[-1]), longest_within(counts, budget), *([counts.tolist()] if keep_prefixes else [])))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * keep_prefixes
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return table.select("doc_id", "n_bytes", "share", "shared", "more").mapInArrow(answer, schema)


def count_at(position: str | int) -> Column:
    """Column over a stored table: tokens of the first ``position`` characters, all of a shorter text; without Python."""
    at = F.least(F.col(position) if isinstance(position, str) else F.lit(position), F.length("more") - 1).cast("int")
    number = lambda data: F.conv(F.hex(data), 16, 10).cast("long")
    place = F.floor(at / F.col("share")).cast("int") * 4
    low_first = F.concat(*(F.substring(F.col("shared"), place + k, F.lit(1)) for k in (4, 3, 2, 1)))
    return number(low_first) + number(F.substring(F.col("more"), at + 1, F.lit(1)))


def prefix_counts(docs: DataFrame, tokenizer_path: str | None = None, budget: int = LIMIT, keep_prefixes: bool = False) -> DataFrame:
    """``within`` over a table that is stored for it."""
    return within(prefix_table(docs, tokenizer_path), budget, keep_prefixes)


def tokens_at(position: str | int, prefixes: str = "prefix_tokens") -> Column:
    """Column: tokens of the first ``position`` characters, from an array of counts."""
    at = F.col(position) if isinstance(position, str) else F.lit(position)
    return F.element_at(prefixes, F.least(at, F.size(prefixes) - 1).cast("int") + 1)
