"""Toxicity scores of texts restored from a noisy channel.

Writers hide words by look-alike characters, spaced or dotted letters and
repeated letters. Each token for which there is a choice, and each stretch of
spaced-out letters, becomes a lattice: at every character the letters it may
stand for, the choice to drop a separator, and the choice to drop a repetition.
A Viterbi search under a character trigram model, counted over the whole corpus,
picks the most likely letters. A logistic model over the restored words, their
beginnings, and how many different words share a beginning gives the score. It
is fitted on whole documents and on their words dealt into parts, so that a text
with few of the words that usually come together is recognised too.

Defined cases: a null or empty text has no words and gets the score of a text
without features; words without doubled letters stay as they are (lower-cased),
other tokens are scored both as read and as they stand; full-width letters count
as plain ones and characters of no width are left out; stretches are decoded
whole, whatever their length; repeated documents score alike; labels that are
null or of unknown documents are not learned; an empty label table gives the
score 0 for all; an empty document table gives an empty result; a column of the
score's name is replaced, other columns are carried along.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitwork.llm.common import fold, pieces_of, stored, texts, trim

THRESHOLD = 0.7
#: Labelled documents that the classifier is fitted on, at most (by hash of the id), and the features it keeps.
TRAIN_DOCS, FEATURES = 20_000, 512
#: Lengths of word beginnings that are features beside whole words, numbers of different words with one that are told apart, and fewest learned rows of a feature.
BEGINNINGS, SHARED, LEAST_DOCS = (4, 5, 6, 7), 3, 4
#: Parts that the words of a document are dealt into, to be learned beside the whole.
PARTS = 2
#: Distinct words a worker remembers: what they add to a score, and their readings.
CACHE_WORDS, CACHE_READINGS = 150_000, 20_000
#: UTF-8 bytes of documents handled at a time, but for a single longer one.
PIECE_BYTES = 4_000_000

# The letters that characters are used for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
# Cyrillic and Greek letters that look like Latin ones.
OTHER_SCRIPTS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
SEPARATORS = set(" .-_*~'’·,/\\")
_LIKE = re.compile("[" + "".join(OTHER_SCRIPTS) + "]")
#: Full-width forms of ASCII, characters of no width, and strokes laid over letters.
_ODD = re.compile("[\uff01-\uff5e\u00ad\u200b-\u200f\u2060\ufeff\u0334-\u0338]")

#: Character classes of the language model: 0 for all but letters, a-z, and the accented letters of Latin-1.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[223:247] = np.arange(27, 51)
_CLASS[248:256] = np.arange(51, 59)
_CLASSES = 64
_TABLE = bytes(_CLASS)

_SPACED = re.compile(r"(?<!\S)(?:[^\s\w]*[^\W_][^\s\w]*\s+)+[^\s\w]*[^\W_](?!\w)")
_REPEAT = re.compile(r"([^\W\d_])\1")
_EDGE = "%*#&.,;:?\"“”'()[]{}<>=~^`"


def lowered(text: str) -> str:
    """Lower case, full-width letters as plain ones, without characters of no width."""
    if not text.isascii() and _ODD.search(text):
        text = _ODD.sub(lambda m: chr(ord(m[0]) - 0xFEE0) if m[0] >= "\uff01" and m[0] <= "\uff5e" else "", text)
    return text.lower()


class Letters:
    """Character trigram model: log2 probability of a class after two others, backed off by add-one bigrams."""

    def __init__(self, trigrams: np.ndarray) -> None:
        counts = trigrams.reshape(_CLASSES, _CLASSES, _CLASSES).astype(np.float64)
        two = counts.sum(0)
        low = (two + 1) / (two.sum(1, keepdims=True) + _CLASSES)
        self.cost = -np.log2((counts + 4 * low[None]) / (counts.sum(2, keepdims=True) + 4))


def class_codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("latin-1", "replace").translate(_TABLE), np.uint8)


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all documents: partial counts per batch, summed by Spark into at most 64**3 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(_CLASSES**3, np.int64), [], 0
        for batch in pieces_of(batches, PIECE_BYTES):
            for text in texts(batch):
                c = class_codes(" " + text + " ").astype(np.int32)
                held.append((c[:-2] << 12) + (c[1:-1] << 6) + c[2:])
                size += len(c)
                if size > 1_000_000:  # counted together, since one count touches the whole table
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    rows = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_CLASSES**3, np.int64)
    out[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return out


class Decoder:
    """Viterbi search through character lattices."""

    #: Costs in bits: reading a character as another letter, dropping a separator, dropping a repetition (of three or
    #: more letters, or of two), keeping a sign (alone, or beside a letter).
    SWAP, DROP, ONCE, TWICE, SIGN, INSIDE = 2.0, 1.5, 1.0, 6.0, 3.0, 9.0

    def __init__(self, letters: Letters) -> None:
        self._cost = letters.cost

    def _options(self, text: str, at: int) -> list[tuple[str, float]]:
        """What the character at ``at`` may stand for, and the channel's cost of that."""
        c = text[at]
        if c.isalpha():
            own = [(c, 0.0), (OTHER_SCRIPTS[c], self.SWAP)] if c in OTHER_SCRIPTS else [(c, 0.0)]
            if not (at and text[at - 1] == c):
                return own
            more = text[at + 1 : at + 2] == c or text[at - 2 : at - 1] == c
            return [*own, ("", self.ONCE if more else self.TWICE)]
        out = [(x, self.SWAP) for x in LOOK_ALIKES.get(c, "")]
        if c in SEPARATORS:
            out.append(("", self.DROP))
        if c.isdigit() or c in LOOK_ALIKES:
            beside = text[max(0, at - 1) : at + 2]
            out.append((c, self.INSIDE if any(x.isalpha() for x in beside) else self.SIGN))
        else:
            out.append((" ", 0.0 if c.isspace() else self.SIGN))
        if at and text[at - 1] == c:
            out.append(("", self.ONCE))
        return out

    def decode(self, text: str) -> str:
        """The likeliest reading of a lower-case stretch."""
        cost = self._cost
        # a reading is its last letter and the reading before; those of all states share what they have in common
        known: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for at in range(len(text)):
            step: dict[tuple[int, int], tuple[float, tuple]] = {}
            options = self._options(text, at)
            for (a, b), (so_far, read) in known.items():
                for letter, price in options:
                    if letter:
                        code = ord(letter)
                        c = int(_CLASS[code]) if code < 256 else 0
                        state, total = (b, c), so_far + price + cost[a, b, c]
                    else:
                        state, total = (a, b), so_far + price
                    if state not in step or total < step[state][0]:
                        step[state] = (total, (letter, read) if letter else read)
            known = step
        read = min(((total + cost[a, b, 0], read) for (a, b), (total, read) in known.items()), key=lambda x: x[0])[1]
        out = []
        while read:
            letter, read = read
            out.append(letter)
        return "".join(reversed(out))


class Restorer:
    """Words of a text as they were meant."""

    def __init__(self, trigrams: np.ndarray) -> None:
        self._decoder = Decoder(Letters(trigrams))
        self._known: dict[str, tuple[str, ...]] = {}

    def word(self, token: str) -> tuple[str, ...]:
        """The restored words of one white-space token."""
        if (got := self._known.get(token)) is not None:
            return got
        core = token.strip(_EDGE).rstrip("!")
        if not core:
            got = ()
        elif not core.isascii() and _LIKE.search(core):
            got = tuple(dict.fromkeys((*self._decoder.decode(core).split(), *re.findall(r"[^\W\d_]+", core))))
        elif core.isalpha() and not _REPEAT.search(core):
            got = (core,)
        elif core.rstrip("$").isalpha() and not _REPEAT.search(core):
            got = tuple(dict.fromkeys((core.rstrip("$"), *self._decoder.decode(core).split())))
        elif any(c.isalpha() for c in core):
            plain = re.findall(r"[^\W\d_]+", core)
            got = tuple(dict.fromkeys((*self._decoder.decode(core).split(), *plain)))
        else:
            got = tuple(dict.fromkeys((*self._decoder.decode(core).split(), core)))
        if len(self._known) < CACHE_READINGS:
            self._known[token] = got
        return got

    def spaced(self, text: str) -> list[str]:
        """Restored words of spaced-out stretches, such as single letters in a row."""
        out = []
        for m in _SPACED.finditer(text):
            stretch = m[0]
            if len(set(stretch)) > 2:
                out += self._decoder.decode(stretch).split()
        return out

    def text(self, text: str) -> str:
        """The text with each word replaced by its first reading and spaced-out stretches joined."""
        low = _SPACED.sub(lambda m: self._decoder.decode(m[0]) if len(set(m[0])) > 2 else m[0], lowered(text))
        return " ".join((self.word(w) or (w,))[0] for w in low.split())

    def words(self, text: str) -> set[str]:
        low = lowered(text)
        out = set()
        for w in set(low.split()):
            out.update(self.word(w))
        out.update(self.spaced(low))
        return out


def beginnings(word: str) -> list[str]:
    return [word[:k] for k in BEGINNINGS if len(word) > k]


def shared(number: dict[str, int]) -> set[str]:
    """Features for the numbers of different words with the same beginning: at least one, two, and so on up to SHARED."""
    return {f"{b}*{k}" for b, n in number.items() for k in range(1, min(n, SHARED) + 1)}


def features(words: set[str]) -> set[str]:
    return words | shared(Counter(b for w in words for b in beginnings(w)))


def parts(words: set[str], doc: int) -> list[set[str]]:
    """The words of a document, dealt by hash."""
    out: list[set[str]] = [set() for _ in range(PARTS)]
    for w in words:
        out[zlib.crc32(f"{doc}/{w}".encode()) % PARTS].add(w)
    return out


def restore(docs: DataFrame, trigrams: np.ndarray | None = None) -> DataFrame:
    """Documents with a column ``restored``."""
    sent = docs.sparkSession.sparkContext.broadcast(count_trigrams(docs) if trigrams is None else trigrams)
    names = [f.name for f in docs.schema.fields]
    if "restored" in names:
        docs, names = docs.drop("restored"), [n for n in names if n != "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value)
        for batch in pieces_of(batches, PIECE_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([restorer.text(t) for t in texts(batch)], pa.string())], names=[*names, "restored"])

    from pyspark.sql.types import StringType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("restored", StringType())]))


class Model:
    """Logistic regression over the presence of features."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias

    def score(self, present: float) -> float:
        z = max(-30.0, min(30.0, self.bias + present))
        return 1 / (1 + math.exp(-z))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Text and label of at most about ``most`` training documents, chosen by hash of the id."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.filter(F.col("toxic").isin(0, 1) & (fold("doc_id", 3) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keep = min(1_000_000, math.ceil(1_000_000 * most / max(1, usable.count())))
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < keep)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, trigrams: np.ndarray, most: int = TRAIN_DOCS) -> Model:
    """Learn from the labelled training fold: feature counts by Spark, weights on a bounded matrix."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(trigrams)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value)
        for batch in pieces_of(batches, PIECE_BYTES):
            found = [sorted(restorer.words(t)) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])
        del restorer
        trim()

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, words in zip(batch.column("toxic").to_pylist(), batch.column("words").to_pylist(), strict=True):
                own = list(features(set(words)))
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(own), pa.int32()), pa.array(own, pa.string())], names=["toxic", "feature"])

    rows = stored(_sample(docs, labels, most).mapInArrow(extract, "doc_id long, toxic int, words array<string>"), "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n1 or not n0:
        return Model({}, 30.0 if n1 else -30.0)
    # features are chosen by whole documents, their weights fitted on parts as well
    counts = rows.select("toxic", "words").mapInArrow(flat, "toxic int, feature string").groupBy("feature").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n"))
    expected = F.col("n") * n1 / (n0 + n1)
    gain = F.col("pos") * F.log((F.col("pos") + 0.01) / expected) - (F.col("pos") - expected)
    best = counts.filter((F.col("n") >= LEAST_DOCS) & (F.col("pos") > 2 * expected)).orderBy(gain.desc(), "feature").limit(FEATURES)
    names = [r["feature"] for r in best.collect()]
    if not names:
        return Model({}, math.log(n1 / n0))
    wanted = spark.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = wanted.value
        for batch in batches:
            for doc, toxic, words in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "words")), strict=True):
                own = [sorted(number[f] for f in features(x) if f in number) for x in (set(words), *parts(set(words), doc))]
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(own), pa.int32()), pa.array(own, pa.list_(pa.int32()))], names=["toxic", "own"])

    kinds = rows.mapInArrow(select, "toxic int, own array<int>").groupBy("own").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).collect()
    x = np.zeros((len(kinds), len(names)))
    for k, r in enumerate(kinds):
        x[k, r["own"]] = 1
    pos, n = np.array([r["pos"] for r in kinds], float), np.array([r["n"] for r in kinds], float)
    return Model(*_logistic(x, pos, n, names))


def _logistic(x: np.ndarray, pos: np.ndarray, n: np.ndarray, names: list[str], ridge: float = 2.0, rounds: int = 400) -> tuple[dict[str, float], float]:
    """Non-negative weights by projected accelerated gradient descent on the penalised likelihood."""
    w, bias = np.zeros(x.shape[1]), math.log((pos.sum() + 1) / (n.sum() - pos.sum() + 1))
    rate = 1 / (0.25 * float(np.linalg.norm(x * np.sqrt(n)[:, None], 2) ** 2) + ridge)
    bias_rate, before, push = 4 / n.sum(), w, 1.0
    for _ in range(rounds):
        after = (1 + math.sqrt(1 + 4 * push**2)) / 2
        v = w + (push - 1) / after * (w - before)
        error = n / (1 + np.exp(-np.clip(x @ v + bias, -30, 30))) - pos
        before, push = w, after
        w = np.maximum(0, v - rate * (x.T @ error + ridge * v))
        bias -= bias_rate * error.sum()
    return {f: float(k) for f, k in zip(names, w, strict=True) if k > 1e-6}, float(bias)


class Scorer:
    """Scores of whole texts; what a word adds is remembered per worker."""

    def __init__(self, trigrams: np.ndarray, model: Model) -> None:
        self._restorer, self._model = Restorer(trigrams), model
        self._begun = {f.rpartition("*")[0] for f in model.weights if "*" in f}
        self._known: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {}

    def _relevant(self, words: Iterable[str]) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """Those of the words that have a say, with their beginnings that have one."""
        own = ((w, tuple(b for b in beginnings(w) if b in self._begun)) for w in words)
        return tuple((w, b) for w, b in own if b or w in self._model.weights)

    def _of_token(self, token: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
        got = self._relevant(self._restorer.word(token))
        if len(self._known) < CACHE_WORDS:
            self._known[token] = got
        return got

    def score(self, text: str) -> float:
        low, known, weights = lowered(text), self._known, self._model.weights
        tokens = set(low.split())
        found = list(map(known.get, tokens))
        if None in found:
            found = [self._of_token(w) if f is None else f for w, f in zip(tokens, found, strict=True)]
        words = dict(x for own in found if own for x in own) | dict(self._relevant(self._restorer.spaced(low)))
        present = set(words) | shared(Counter(b for own in words.values() for b in own))
        return self._model.score(sum(weights[f] for f in sorted(present) if f in weights))


def score(docs: DataFrame, model: Model, trigrams: np.ndarray, column: str = "score") -> DataFrame:
    """All columns of the documents, and their score (any column of that name is replaced)."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.drop(column)
    sent = docs.sparkSession.sparkContext.broadcast((trigrams, model))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in pieces_of(batches, PIECE_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([scorer.score(t) for t in texts(batch)], pa.float64())], names=[*names, column])
        del scorer
        trim()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, column: str = "score") -> DataFrame:
    """``docs`` with a score, by a model learned on their labelled training fold."""
    trigrams = count_trigrams(docs)
    return score(docs, fit(docs, labels, trigrams), trigrams, column)
