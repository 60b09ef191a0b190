"""Language identification by hyperdimensional profiles.

Every letter gets a random vector of +1 and -1. A trigram's vector binds the
letter vectors of its three places, each permuted once per place further left,
by multiplication; a text's profile bundles the vectors of its trigrams by
addition. A language's prototype bundles all its training texts, freed of what
the languages have in common; the language whose prototype has the largest
cosine with the profile wins.

A batch of texts is bundled by one matrix product of its trigram counts with the
vectors of the trigrams that occur, which is the same sum.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
rows without a language are not learned; languages tie by name; with no training
rows every text is ``und``; repeated rows count as often as they occur; very
long texts are counted whole; an empty table gives an empty result; columns
``lang_pred`` and ``score`` are replaced, others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitwork.llm.common import texts

DIMENSIONS, SEED = 1024, 20231
UNKNOWN = "und"
#: Letter classes: 0 for the space between words, a-z, and other letters by their code point.
CLASSES = 64
#: Letters counted in one matrix product, but for a single longer text.
BLOCK_LETTERS = 300_000
#: Letters counted together in a task before their counts are passed on, but for a single longer text.
COUNTED_LETTERS = 4_000_000
#: Languages that a model may have; more are a sign of a wrong column.
MOST_LANGUAGES = 2_000

_TABLE_SIZE = 0x3000


def _letter_table() -> np.ndarray:
    """Class of every code point below _TABLE_SIZE, by its lower-case form."""
    out = np.zeros(_TABLE_SIZE, np.uint8)
    for code in range(_TABLE_SIZE):
        if chr(code).isalpha():
            low = ord(chr(code).lower()[0])
            out[code] = low - 96 if 97 <= low <= 122 else 27 + low % (CLASSES - 27)
    return out


_LETTERS = _letter_table()


def trigrams(text: str) -> np.ndarray:
    """Codes of the letter trigrams of a text; words are set apart by one space. Empty without letters."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letters = _LETTERS[np.minimum(code, _TABLE_SIZE - 1)]
    if len(code) and code.max() >= _TABLE_SIZE:
        for at in np.flatnonzero(code >= _TABLE_SIZE):
            letters[at] = 27 + int(code[at]) % (CLASSES - 27) if chr(code[at]).isalpha() else 0
    if not letters.any():
        return np.zeros(0, np.int32)
    letters = np.concatenate([[0], letters, [0]]).astype(np.int32)
    letters = letters[np.concatenate([[True], (letters[1:] != 0) | (letters[:-1] != 0)])]
    return (letters[:-2] << 12) + (letters[1:-1] << 6) + letters[2:]


class Space:
    """Vectors of letters and trigrams."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CLASSES, dimensions))
        self._places = [np.roll(letters, place, axis=1) for place in (2, 1, 0)]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = self._places
        return (a[codes >> 12] * b[(codes >> 6) & 63] * c[codes & 63]).astype(np.float32)


class Profiler:
    """Bundles blocks of texts; the vectors of trigrams seen so far are kept (at most CLASSES**3)."""

    def __init__(self, space: Space, kept: int = 32_768) -> None:
        self._space, self._kept = space, kept
        self._slot = np.full(CLASSES**3, -1, np.int32)
        self._rows: np.ndarray | None = None
        self._used = 0

    def _vectors(self, codes: np.ndarray) -> np.ndarray:
        new = codes[self._slot[codes] < 0]
        if self._used + len(new) > self._kept:
            return self._space.vectors(codes)
        if len(new):
            fresh = self._space.vectors(new)
            self._slot[new] = self._used + np.arange(len(new))
            self._used += len(new)
            self._rows = fresh if self._rows is None else np.concatenate([self._rows, fresh])
        return self._rows[self._slot[codes]]

    def bundle(self, block: list[np.ndarray]) -> np.ndarray:
        """Profile of each list of trigrams."""
        stream = np.concatenate(block)
        seen = np.zeros(CLASSES**3, bool)
        seen[stream] = True
        codes = np.flatnonzero(seen)
        local = np.zeros(CLASSES**3, np.int64)
        local[codes] = np.arange(len(codes))
        row = np.repeat(np.arange(len(block)), [len(x) for x in block])
        counts = np.bincount(row * len(codes) + local[stream], minlength=len(block) * len(codes)).astype(np.float32)
        return counts.reshape(len(block), len(codes)) @ self._vectors(codes)


def count_by_language(docs: DataFrame) -> DataFrame:
    """(lang, code, n): trigram counts of each language over all the given rows; partial counts per task, summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def settle() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                total = np.bincount(np.concatenate(own), minlength=CLASSES**3)
                codes = np.flatnonzero(total)
                n = total[codes]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                own = trigrams(text)
                held.setdefault(lang, []).append(own)
                size += len(own)
                if size > COUNTED_LETTERS:
                    yield from settle()
                    size = 0
        yield from settle()

    known = docs.filter(F.col("lang").isNotNull()).select("lang", "text")
    return known.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def bundles(counts: DataFrame, dimensions: int) -> dict[str, np.ndarray]:
    """The bundled vector of each language, made where its counts are: a group has a row per trigram at most, the driver gets a vector per language."""

    def bundle(table: pa.Table) -> pa.Table:
        table = table.sort_by("code")
        codes, n = table.column("code").to_numpy(), table.column("n").to_numpy().astype(np.float32)
        space, total = Space(dimensions), np.zeros(dimensions, np.float64)
        for at in range(0, len(codes), 4096):
            total += n[at : at + 4096] @ space.vectors(codes[at : at + 4096])
        return pa.table({"lang": table.column("lang").slice(0, 1), "vector": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    out = {}
    for row in counts.groupBy("lang").applyInArrow(bundle, "lang string, vector binary").toLocalIterator():
        if len(out) >= MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        out[row["lang"]] = np.frombuffer(row["vector"], np.float32)
    return out


class Prototypes:
    """Unit vectors of the languages, less their common part."""

    def __init__(self, bundled: dict[str, np.ndarray]) -> None:
        self.languages = sorted(k for k, v in bundled.items() if v.any())
        rows = [bundled[k] / np.linalg.norm(bundled[k]) for k in self.languages]
        self.vectors = np.array(rows, np.float32)
        self.common = self.vectors.mean(0) if rows else np.zeros(0, np.float32)
        if len(rows) > 1:
            self.vectors = self.vectors - self.common
            self.vectors /= np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-9)

    def nearest(self, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and cosine, moved from -1 ... 1 to 0 ... 1."""
        own = profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-9)
        if len(self.languages) > 1:
            own = own - self.common
            own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
        cosine = own @ self.vectors.T
        best = cosine.argmax(1)
        return best, np.clip((1 + cosine[np.arange(len(best)), best]) / 2, 0, 1)


def fit(docs: DataFrame, dimensions: int = DIMENSIONS) -> Prototypes:
    return Prototypes(bundles(count_by_language(docs), dimensions))


def identify(docs: DataFrame, prototypes: Prototypes, dimensions: int = DIMENSIONS) -> DataFrame:
    """All columns of the documents, with ``lang_pred`` and ``score`` (columns of these names are replaced)."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    docs = docs.drop("lang_pred", "score")
    names, sent = docs.columns, docs.sparkSession.sparkContext.broadcast(prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, profiler = sent.value, Profiler(Space(dimensions))
        for batch in batches:
            langs, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            held: list[tuple[int, np.ndarray]] = []

            def settle() -> None:
                if held and model.languages:
                    best, score = model.nearest(profiler.bundle([x for _, x in held]))
                    for (k, _), lang, s in zip(held, best, score, strict=True):
                        langs[k], scores[k] = model.languages[lang], float(s)
                held.clear()

            size = 0
            for k, text in enumerate(texts(batch)):
                codes = trigrams(text)
                if len(codes):
                    held.append((k, codes))
                    size += len(codes)
                if size > BLOCK_LETTERS or len(held) >= 256:
                    settle()
                    size = 0
            settle()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
