"""Vector codes, vantage-point trees and the alignment of tokenizers against brute force and defined edge cases."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from knitwork.llm import alignment, catalogue, vantage_trees, vector_codes

VECTORS = "vec_id long, label int, embedding array<double>, code string, rank int, cells int, vector string, key int"


def vectors(spark, rows):
    return spark.createDataFrame([(k, label, None if v is None else [None if x is None else float(x) for x in v], "x", 1, 2, "y", 3) for k, label, v in rows], VECTORS)


NOT_USABLE = [(9001, 1, None), (9002, 1, []), (9003, 1, [1.0, None, 2.0, 3.0]), (9004, 1, [1.0, float("nan"), 2.0, 3.0]), (9005, 1, [1.0, float("inf"), 2.0, 3.0]), (9006, 1, [1.0, 2.0])]


# 11 vector codes


def plain_codes(rows, parts, entries, rounds, scale):
    """vec_id -> (code, error) by exhaustive search over Python integers, and the codebooks."""
    cells = [(k, [math.floor(scale * x) for x in v]) for k, _, v in rows]
    size = len(cells[0][1]) // parts
    first = sorted(cells)[:entries]
    books = [[c[p * size : (p + 1) * size] for _, c in first] for p in range(parts)]

    def assign(p, c):
        own = c[p * size : (p + 1) * size]
        return min((sum((a - b) ** 2 for a, b in zip(own, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        members = [defaultdict(list) for _ in range(parts)]
        for _, c in cells:
            for p in range(parts):
                members[p][assign(p, c)[1]].append(c[p * size : (p + 1) * size])
        for p in range(parts):
            for k, own in members[p].items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [assign(p, c) for _, c in cells for p in range(parts)]
    out = [(k, "".join(f"{e:02x}" for _, e in found[i * parts : (i + 1) * parts]), sum(d for d, _ in found[i * parts : (i + 1) * parts])) for i, (k, _) in enumerate(cells)]
    return sorted(out), books


@pytest.mark.parametrize("spread", [0.003, 1.0, 3000.0])
def test_vector_codes(spark, spread):
    """A small spread gives few different integers and so many equal distances; a large one sums that no double holds."""
    rng = np.random.default_rng(5)
    rows = [(int(k), int(k) % 3 or None, rng.normal(0, spread, 8)) for k in rng.permutation(150)]
    df = vectors(spark, rows + NOT_USABLE).repartition(5)
    codes, books = vector_codes.compress(df, parts=4, entries=20, rounds=3)
    want, want_books = plain_codes(rows, 4, 20, 3, 1024)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in codes.collect()) == want
    assert [b.tolist() for b in books] == want_books
    labels = {k: label for k, label, _ in rows}
    total = defaultdict(int)
    for k, _, error in want:
        total[labels[k]] += error
    got = {r["vec_id"]: r["label_error"] for r in vector_codes.with_label_errors(codes).collect()}
    assert got == {k: total[labels[k]] for k in labels}
    near = np.abs(vector_codes.decoded(want[0][1], books) - next(v for k, _, v in rows if k == 0)).max()
    assert near <= spread * 8


def test_vector_codes_defined_cases(spark):
    assert vector_codes.compress(vectors(spark, NOT_USABLE[:1]))[0].count() == 0
    assert vector_codes.with_label_errors(vector_codes.compress(vectors(spark, []).limit(0))[0]).count() == 0
    # repeated rows, rows with one id, null ids and labels, equal vectors, fewer vectors than entries, a length that parts do not divide
    rows = [(1, None, [1, 2, 3, 4, 5]), (1, None, [1, 2, 3, 4, 5]), (1, 2, [0, 2, 3, 4, 5]), (None, 2, [9, 9, 9, 9, 9]), (7, 2, [1, 2, 3, 4, 5]), (8, 2, [1e12, 0, 0, 0, 0])]
    codes, books = vector_codes.compress(vectors(spark, rows), rounds=1)
    got = sorted((r["vec_id"] or -1, r["error"]) for r in codes.collect())
    assert [k for k, _ in got] == [-1, 1, 1, 1, 7]
    assert [b.shape for b in books] == [(3, 2), (3, 1), (3, 1), (3, 1)]
    with pytest.raises(ValueError):
        vector_codes.compress(vectors(spark, rows), entries=257)


def test_kd_tree_keeps_lower_index():
    rng = np.random.default_rng(1)
    for width, high in ((1, 3), (3, 2), (5, 40)):
        entries, points = rng.integers(-high, high, (200, width)), rng.integers(-high, high, (700, width))
        entry, distance = vector_codes.KdTree(entries, leaf=4).nearest(points)
        whole = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (whole.argmin(1) == entry).all() and (whole.min(1) == distance).all()


# 12 vantage-point trees


def plain_neighbours(rows, k, is_query):
    out = []
    for i, (q, _, v) in enumerate(rows):
        if q is not None and is_query(q):
            scored = [(-float(np.cumsum(np.multiply(v, w))[-1]), c if c is not None else 1 << 62, j) for j, (c, _, w) in enumerate(rows) if j != i]
            out += [(q, rank, None if c == 1 << 62 else c, -s) for rank, (s, c, _) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def clustered(n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, 6)) * 4
    rows = [(int(k), 0, centres[k % 12] + rng.normal(0, 0.2, 6)) for k in range(n)]
    return rows + [(int(n + k), 0, rows[5][2]) for k in range(n // 3)]  # copies: ties at every place


def test_vantage_trees_are_exact(spark):
    rows = clustered(900) + [(None, 0, rows5) for rows5 in [np.ones(6)]] + [(40, 0, np.ones(6)), (40, 0, np.ones(6))]
    df = vectors(spark, rows + NOT_USABLE[:2] + [(60_000, 0, [0.0] * 6)]).repartition(7)
    for pivots, size, leaf in ((256, 256 * 48, 8), (1, 1 << 30, 64)):
        index = vantage_trees.build(df, most_pivots=pivots, shard_bytes=size, leaf=leaf)
        queries = index.rows.filter("vec_id % 20 = 0").select("key", "vec_id", "vector")
        got = vantage_trees.search(index, queries, k=20, queries_per_task=30).collect()
        got = sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got), key=str)
        assert got == plain_neighbours(rows, 20, lambda q: q % 20 == 0)


def test_vantage_trees_recall_and_pruning():
    """Clustered vectors: a factor above 1 looks at fewer rows and finds at least nine in ten."""
    rng = np.random.default_rng(8)
    data = rng.normal(0, 4, (60, 6))[np.arange(8000) % 60] + rng.normal(0, 0.2, (8000, 6))
    data /= np.sqrt((data * data).sum(1))[:, None]
    keys = np.arange(len(data))
    tree = vantage_trees.Tree(keys, keys, data, float((data * data).sum(1).max()) * (1 + 1e-12))
    asked = rng.choice(len(data), 200, replace=False)
    last = np.sort(data[asked] @ data.T, axis=1)[:, -21]
    visited, recall = {}, {}
    for factor in (1.0, 2.0, 3.0):
        search = vantage_trees.Search(tree, data[asked], keys[asked], np.full(200, -np.inf), 20, factor)
        q, _, score = search.run()
        visited[factor], recall[factor] = search.visited / (200 * len(data)), float((score >= last[q] - 1e-9).sum()) / (200 * 20)
    assert recall[1.0] == 1.0 and recall[2.0] >= 0.97 and recall[3.0] >= 0.9
    assert visited[1.0] < 0.1 and visited[2.0] < visited[1.0] / 1.5 and visited[3.0] < visited[2.0]


def test_vantage_trees_defined_cases(spark):
    run = lambda rows: [tuple(r) for r in vantage_trees.neighbours(vectors(spark, rows), lambda c: c % 20 == 0).orderBy("query_id", "rank").collect()]
    assert run([]) == [] and run(NOT_USABLE[:2]) == [] and run([(20, 1, [1, 2])]) == []
    assert run([(20, 1, [1, 2]), (3, None, [0, 5]), (4, 1, [0, 5]), (None, 1, [-1, 0])]) == [(20, 1, 3, 10.0), (20, 2, 4, 10.0), (20, 3, None, -1.0)]
    with pytest.raises(ValueError):
        index = vantage_trees.build(vectors(spark, [(1, 1, [1, 2])]))
        vantage_trees.search(index, index.rows, factor=0.5)


# 13 alignment


class Plain:
    """The two libraries on whole texts, and loops over all tokens."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [x for x in range(256) if x not in kept]
        self.letters = {chr(x): x for x in kept} | {chr(256 + k): x for k, x in enumerate(moved)}

    def bytes_a(self, k):
        return bytes(self.letters[c] for c in self.a.id_to_token(k))

    def bytes_b(self, k):
        p = self.b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        a, b, want = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode()
        if b"".join(map(self.bytes_a, a)) != want or b"".join(map(self.bytes_b, b)) != want:
            return [], []
        return a, b

    def spans(self, ids, of):
        out, at = [], 0
        for k in ids:
            out.append((at, at := at + len(of(k)), k))
        return out

    def align(self, text):
        a, b = self.tokens(text)
        a, b = self.spans(a, self.bytes_a), self.spans(b, self.bytes_b)
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = []
        for since, until in zip([0, *ends], ends, strict=False):
            own = lambda spans, s=since, u=until: ",".join(str(k) for x, y, k in spans if s <= x and y <= u)
            groups.append(f"{own(a)}|{own(b)}")
        links = [(i[2], j[2], max(i[0], j[0]), min(i[1], j[1])) for i in a for j in b if i[0] < j[1] and j[0] < i[1]]
        return len(a), len(b), groups, links

    def whole(self, texts):
        found = [self.align(t) for t in texts]
        count = defaultdict(int)
        for *_, links in found:
            for pair in {x[:2] for x in links}:
                count[pair] += 1
        best = defaultdict(int)
        for (a, _), n in count.items():
            best[a] = max(best[a], n)
        out = []
        for n_a, n_b, groups, links in found:
            of = [(a, count[a, b]) for a, b, _, _ in links]
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
            out.append((n_a, n_b, len(groups), len(links), sum(n == best[a] for a, n in of), sum(n for _, n in of), digest))
        return out


SOME = [None, "", " ", "  ", "\n", "a", " a", "a ", "the the the", "the the the", "don't  stop\n\n now", "x▁y", "ﬁne éé 漢字\U0001f642 <|endoftext|> </s> <0x0A> x",
        "tab\t tab \x85 \xa0nbsp 　 wide ​ zero­", "a\x00b \x1c c", "word" * 40, "sp    aces     and\r\n\r\nlines ", "Straße 1234567 ... !!!??", "नमस्ते мир"]


def made_texts(n):
    rng = np.random.default_rng(4)
    parts = ["the", " ", " ", " ", "  ", "\n", "\t", "Token", "izer", "'s", "12", "é", "漢", "\U0001f642", ".", ",", "▁", "\xa0", "​", "　", "<s>", "<|endoftext|>", "unbe", "liev", "able", "ǅ", "́", "\x1f", " "]
    return ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(n)]


def test_words_are_encoded_as_whole_texts_are():
    plain = Plain()
    encoders = alignment.Encoders(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t for t in SOME if t] + made_texts(4000)
    for text, (a, b) in zip(texts, encoders.ids(texts), strict=True):
        assert (a.tolist(), b.tolist()) == plain.tokens(text), repr(text)


@pytest.mark.parametrize(("run", "at_once"), [(4096, 400_000), (3, 5)])
def test_alignment(spark, run, at_once, monkeypatch):
    """Also with runs of three tokens and few at a time, so that documents go through the sweep in many pieces."""
    monkeypatch.setattr(alignment, "AT_ONCE", at_once)
    texts = SOME + made_texts(60)
    rows = [(None if k == 3 else k // 2, t, 1, "a", 2) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, links int, pair string, block int").repartition(3)
    got = alignment.align(df, run=run, block_links=50)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(r[0], *x) for r, x in zip(rows, Plain().whole(texts), strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_sweep_in_pieces(monkeypatch):
    """The machine itself, in this process: pieces and whole give the same."""
    import pyarrow as pa

    monkeypatch.setattr(alignment, "AT_ONCE", 4)
    encoders = alignment.Encoders(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    text = "unbelievable tokenization of 漢字 words " * 9
    ((a, b),) = encoders.ids([text])
    sizes = [np.array(list(map(len, x))) for x in encoders.bytes]
    rows = []
    for side, ids in enumerate((a, b)):
        ends = np.cumsum(sizes[side][ids])
        rows += [(0, 5, int(ends[k - 1]) if k else 0, side, ids[k : k + 2].astype(np.uint16).tobytes()) for k in range(0, len(ids), 2)]
    rows.sort(key=lambda r: (r[2], r[3]))
    cut = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 7], strict=True)], names=["row", "doc_id", "offset", "side", "ids"]) for k in range(0, len(rows), 7)]
    (done,) = [d for docs in alignment.Sweep(*encoders.bytes).documents(iter(cut)) for d in docs]
    n_a, n_b, groups, links = Plain().align(text)
    assert done.counts.tolist() == [n_a, n_b, len(groups), len(links)]
    assert done.digest.hexdigest() == hashlib.sha256(";".join(groups).encode()).hexdigest()


def test_links(spark):
    texts = SOME + ["a longer text with unbelievable tokenization " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["start"], r["end"], r["a_id"], r["b_id"]) for r in alignment.links(df, run=4).collect())
    plain = Plain()
    assert got == sorted((k, s, e, a, b) for k, t in enumerate(texts) for a, b, s, e in plain.align(t)[3])


def test_alignment_defined_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty).count() == 0
    long = spark.createDataFrame([(1, "y" * 30_000), (2, "many words " * 30_000), (2, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_a"] > 0, len(r["groups_sha256"])) for r in alignment.align(long).collect())
    assert got == [(1, True, 64), (2, False, 0), (2, True, 64)]


def test_queries_are_registered():
    assert {"op11_vector_codes", "op12_vantage_trees", "op13_alignment"} <= set(catalogue.queries())
