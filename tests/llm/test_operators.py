"""Corpus operators against brute force, libraries, round trips and defined edge cases."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from knitwork.llm import chat, components, decontamination, embedding_dedup, html_text, langid, ngram_join, packing, secrets, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, score string, findings int, lang_pred int"
WORDS = [a + b for a in ("tha", "mor", "kel", "vin", "dus", "pra") for b in ("lin", "tor", "mes", "ka", "del", "sun", "bri")]


def docs(spark, texts, lang=None):
    rows = [(k, t, None if lang is None else lang[k], "x", 1, 2) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


def odd_texts():
    return [None, "", " \n", "word", "word", "é漢字🙂 <|endoftext|> x", "a b c", "long " * 30_000, "x" * 5_000, "\x1c \x85 \xa0"]


# components


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 chat


def test_chat(spark):
    rows = [
        (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 5, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"),
        (4, 0, "user", None), (5, 0, "user", ""), (6, 0, "user", "z"), (6, 0, "user", "z"), (None, 0, None, "n"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    got = {r["conv_id"]: (r["n_turns"], r["n_logged"], r["rendered"]) for r in chat.render(df).collect()}
    assert got == {
        2: (2, 2, "<|user|>\na\n<|assistant|>\nb"), 4: (1, 1, "<|user|>\n"), 5: (1, 1, "<|user|>\n"), 6: (2, 1, "<|user|>\nz\n<|user|>\nz"), None: (1, 1, "<||>\nn"),
    }
    assert chat.render(df.limit(0)).count() == 0
    long = [(9, None, None, "y" * 200_000), (9, 0, "user", "after"), (8, None, None, "y" * 200_000), (7, 3, "a", "p"), (7, 3, "a", "b")]
    got = {r["conv_id"]: (r["n_turns"], len(r["rendered"])) for r in chat.render(spark.createDataFrame(long, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {9: (2, 200_000 + len("<||>\n\n<|user|>\nafter")), 7: (2, len("<|a|>\nb\n<|a|>\np"))}
    named = chat.render(spark.createDataFrame([("x", 0, "u", "a"), (None, 0, "u", "b")], "conv_id string, turn long, role string, text string")).collect()
    assert sorted((r["conv_id"] or "", r["rendered"]) for r in named) == [("", "<|u|>\nb"), ("x", "<|u|>\na")]
    plan = chat.render(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 2 toxicity


def test_decoder(spark):
    tri = toxicity.count_trigrams(docs(spark, ["the idiot and the moron were trash losers " * 50]))
    restorer = toxicity.Restorer(tri)
    for noisy, plain in {"1d10t": "idiot", "i.d.i.o.t": "idiot", "idiooooot": "idiot", "m0r0n": "moron", "tr@sh": "trash", "the": "the"}.items():
        assert plain in restorer.word(noisy), noisy
    assert "idiot" in restorer.text("an i d i o t here")


def test_decoder_has_no_gates(spark):
    tri = toxicity.count_trigrams(docs(spark, ["the idiot and the moron were an ass and trash losers " * 50]))
    restorer = toxicity.Restorer(tri)
    for noisy in ("iddiot", "idiiot", "idiott"):
        assert "idiot" in restorer.word(noisy), noisy
    assert set(restorer.word("455")) >= {"455"} and "ass" in restorer.word("455")
    assert "ass" in restorer.words("an a s s here") and "idiot" in restorer.words("an i  d i   o t here")
    # a word at every place of a long stretch, so that some lie where windows used to end
    for shift in range(0, 12, 3):
        stretch = " ".join("x" * shift + "idiot" * 60)
        assert restorer.text(stretch).count("idiot") == 60, shift


def test_letters_of_other_scripts(spark):
    tri = toxicity.count_trigrams(docs(spark, ["the idiot and the moron were an ass and trash losers " * 50]))
    restorer = toxicity.Restorer(tri)
    for noisy in ("іdiоt", "ιdiοt", "ｉｄｉｏｔ", "i\u200bdi\u00adot", "i\u0336d\u0336i\u0336o\u0336t", "Ｉ d i ο t"):
        assert "idiot" in restorer.words(f"an {noisy} here"), noisy


def test_scorer_against_features(spark):
    """The cached scorer equals the model on the features of all restored words."""
    rng = np.random.default_rng(14)
    tri = toxicity.count_trigrams(docs(spark, [prose(rng, 400)]))
    names = ["kel*1", "kelt*1", "kelt*2", "vinm*3", "vinmes", "thal*1", "mortor", "duska"]
    model = toxicity.Model({f: float(k + 1) / 7 for k, f in enumerate(names)}, -2.0)
    scorer, restorer = toxicity.Scorer(tri, model), toxicity.Restorer(tri)
    for _ in range(60):
        text = prose(rng, int(rng.integers(0, 9))) + rng.choice(["", " kelt0r vinmess", " v i n m e s", " KELTOR keltorx keltory vinmesa vinmesb"])
        want = model.score(sum(w for f, w in model.weights.items() if f in toxicity.features(restorer.words(text))))
        assert abs(scorer.score(text) - want) < 1e-12


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for k in range(240):
        bad = k % 4 == 0
        texts.append(prose(rng, 30) + (" idiot " if bad else " ") + prose(rng, 20))
        labels.append((k, int(bad)))
    hidden = [prose(rng, 30) + " 1d10t " + prose(rng, 20), *odd_texts()]
    labels += [(None, 1), (9999, 1), (10, None)]
    df = docs(spark, texts + hidden)
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(texts) + len(hidden)
    for k in range(240):
        assert (got[k]["score"] >= 0.7) == (k % 4 == 0)
    assert got[240]["score"] >= 0.7 and all(0 <= got[k]["score"] < 0.7 for k in range(241, 240 + len(hidden)))
    assert got[0]["lang_pred"] == 2
    none = toxicity.toxicity(df.limit(5), spark.createDataFrame([], "doc_id long, toxic int"), "s")
    assert [round(r["s"], 6) for r in none.collect()] == [0.0] * 5
    assert toxicity.toxicity(df.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


# 3 language


def test_language(spark):
    rng = np.random.default_rng(1)
    make = {"aa": lambda: " ".join(rng.choice(["banu", "tolo", "mika"], 40)), "bb": lambda: " ".join(rng.choice(["strk", "pfelz", "grüm"], 40))}
    langs = ["aa", "bb"] * 20
    df = docs(spark, [make[x]() for x in langs], langs)
    model = langid.fit(df.filter("doc_id < 20"))
    got = {r["doc_id"]: r for r in langid.identify(df.drop("lang"), model).collect()}
    assert all(got[k]["lang_pred"] == langs[k] and 0 <= got[k]["score"] <= 1 for k in range(40))
    odd = {r["doc_id"]: r for r in langid.identify(docs(spark, odd_texts()), model).collect()}
    assert [odd[k]["lang_pred"] for k in (0, 1, 2, 9)] == ["und"] * 4 and odd[0]["score"] == 0
    assert langid.identify(df.limit(2), langid.fit(df.limit(0))).first()["lang_pred"] == "und"


def test_prediction_against_brute_force(spark):
    """Every letter vector permuted, bound and added one trigram after the other."""
    rng = np.random.default_rng(15)
    make = {"aa": ["banu", "tolo", "mika"], "bb": ["strk", "pfelz", "grüm"], "cc": ["ñora", "llebo", "mika"]}
    langs = ["aa", "bb", "cc"] * 6
    texts = [" ".join(rng.choice(make[x], 12)) for x in langs] + ["Banu, tolo!", "strk llebo", "x", "漢字 пример"]
    dims = 128
    letters = np.random.default_rng(langid.SEED).choice(np.array([-1, 1], np.int8), (langid.CLASSES, dims)).astype(float)

    def profile(text):
        total = np.zeros(dims)
        for code in langid.trigrams(text).tolist():
            total += np.roll(letters[code >> 12], 2) * np.roll(letters[(code >> 6) & 63], 1) * letters[code & 63]
        return total

    unit = lambda v: v / np.linalg.norm(v)
    bundled = {lang: unit(sum(profile(t) for t, x in zip(texts, langs, strict=False) if x == lang)) for lang in make}
    common = sum(bundled.values()) / 3
    prototypes = {lang: unit(v - common) for lang, v in bundled.items()}
    df = docs(spark, texts, [*langs, None, None, None, None])
    got = {r["doc_id"]: r for r in langid.identify(df, langid.fit(df, dims), dims).collect()}
    for k, text in enumerate(texts):
        own = unit(unit(profile(text)) - common)
        cosine = {lang: float(own @ v) for lang, v in prototypes.items()}
        assert got[k]["lang_pred"] == max(cosine, key=cosine.get) and abs(got[k]["score"] - (1 + max(cosine.values())) / 2) < 1e-4
    assert langid.identify(df.limit(0), langid.fit(df, dims), dims).count() == 0
    # languages with the same texts tie: the first name wins
    same = docs(spark, ["banu tolo", "banu tolo", "strk"], ["zz", "yy", "xx"])
    assert langid.identify(same.filter("doc_id = 0"), langid.fit(same)).first()["lang_pred"] == "yy"


def test_bundle_is_the_sum_of_bound_letters():
    space = langid.Space(64)
    codes = langid.trigrams("Ab c")
    want = sum(np.roll(space._places[2][a], 2) * np.roll(space._places[2][b], 1) * space._places[2][c] for a, b, c in ((x >> 12, (x >> 6) & 63, x & 63) for x in codes.tolist()))
    assert np.array_equal(langid.Profiler(space).bundle([codes])[0], want)


# 4 token counts


def test_every_prefix():
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library = token_counts.PrefixCounter(path), Tokenizer.from_file(path)
    for text in ["I're we'll  go\n\n to <|endoftext|> x<|endoft", "a\t b  c　 d é漢字🙂 end   ", "don't 'r", "", "thing. Thing,", "y" * 90 + " z"]:
        assert counter.prefixes(text).tolist() == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


def test_counts(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = odd_texts()
    got = {r["doc_id"]: r for r in token_counts.prefix_counts(docs(spark, texts), budget=3, keep_prefixes=True).withColumn("two", token_counts.tokens_at(2)).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        assert got[k]["n_tokens"] == len(library.encode(t, add_special_tokens=False).ids) == got[k]["prefix_tokens"][-1]
        assert got[k]["n_bytes"] == len(t.encode())
        if len(t) < 100:
            assert got[k]["n_chars_within"] == max(j for j in range(len(t) + 1) if len(library.encode(t[:j]).ids) <= 3)
            assert got[k]["two"] == len(library.encode(t[:2]).ids)


def test_count_edges(spark):
    df = spark.createDataFrame([(None, "a b", 1), (4, "a b", 1), (4, "a b", 1), (5, None, 1)], "doc_id long, text string, n_tokens int")
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["n_bytes"]) for r in token_counts.prefix_counts(df).collect())
    assert got == [(-1, 2, 3), (4, 2, 3), (4, 2, 3), (5, 0, 0)]
    assert token_counts.prefix_counts(df.limit(0)).count() == 0


def test_budgets_are_answered_from_the_stored_table(spark):
    """Any budget and any position, after the texts are gone; the table has no text and is read in place of one."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t for t in odd_texts() if t is None or len(t) < 100] + ["One sentence, \u6f22\u5b57 and  more\n\n of <|endoftext|> it.", "thing. " * 40]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = token_counts.prefix_table(given)
    assert "text" not in table.columns and "MapInArrow" not in table._jdf.queryExecution().toString()
    want = {k: [len(library.encode((t or "")[:j], add_special_tokens=False).ids) for j in range(len(t or "") + 1)] for k, t in enumerate(texts)}
    for budget in (0, 1, 4, 1024):
        got = {r["doc_id"]: (r["n_tokens"], r["n_chars_within"]) for r in token_counts.within(table, budget).collect()}
        assert got == {k: (w[-1], max(j for j, n in enumerate(w) if n <= budget)) for k, w in want.items()}
    for at in (0, 1, 2, 31, 32, 33, 64, 5000):
        got = {r["doc_id"]: r["n"] for r in table.select("doc_id", token_counts.count_at(at).alias("n")).collect()}
        assert got == {k: w[min(at, len(w) - 1)] for k, w in want.items()}


def test_packed_counts():
    rng = np.random.default_rng(2)
    for counts in ([0], [0, 3, 2, 900, 901, 5], rng.integers(0, 5000, 700).tolist(), list(range(0, 4000, 4)), [70_000] * 65):
        share, shared, more = token_counts.packed(np.array(counts, np.int32))
        assert token_counts.unpacked(share, shared, more).tolist() == counts and len(more) == len(counts)


def invented(rng, n):
    """Words of which hardly any two are the same: letters of one and more bytes, marks, digits, signs, long ones."""
    bits = ["th", "ing", "ción", "é", "ß", "漢", "🙂", "'re", "'", "7", "31", "&&&", ",", ".", "Qu", "OU", "zx", "_", "'ve", "ñ"]
    return [" " + "".join(rng.choice(bits, rng.integers(2, 9))) + str(k % 7) * (k % 2) + "ab" * (k % 50 == 0) * 20 for k in range(n)]


def test_new_words_are_not_counted_one_by_one(monkeypatch):
    stepped, alone = [], token_counts.PrefixCounter.byte_prefixes
    monkeypatch.setattr(token_counts.PrefixCounter, "byte_prefixes", lambda self, data: stepped.append(len(data)) or alone(self, data))
    text = "".join(invented(np.random.default_rng(3), 3_000))
    got = token_counts.PrefixCounter(path := public_tokenizers.path("byte_bpe_50k.json")).prefixes(text)
    assert got[-1] == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    assert sum(n <= 32 for n in stepped) == 0  # a word of that length by itself costs some 30 microseconds


def test_odd_white_space_and_long_words_leave_the_rest_together(monkeypatch):
    stepped, alone = [], token_counts.PrefixCounter.byte_prefixes
    monkeypatch.setattr(token_counts.PrefixCounter, "byte_prefixes", lambda self, data: stepped.append(len(data)) or alone(self, data))
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library = token_counts.PrefixCounter(path), Tokenizer.from_file(path)
    words = invented(np.random.default_rng(4), 1_500)
    texts = ["\n\n".join(words[:500]), "\t ".join(words[500:1000]) + "\u3000 ", "".join(words[1000:]) + " x" * 30 + "q" * 600]
    cut = [counter.chunks_of(t) for t in texts]
    counter.learn(cut)
    for text, chunks in zip(texts, cut, strict=True):
        want = [len(e.ids) for e in library.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]
        assert counter.prefixes(text, chunks).tolist() == want
        assert token_counts.unpacked(*token_counts.packed(counter.prefixes(text, chunks))).tolist() == want
    assert sum(4 < n <= 32 for n in stepped) == 0  # of the short ones only runs of white space


def test_new_words_are_counted_together(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library = token_counts.PrefixCounter(path), Tokenizer.from_file(path)
    words = invented(np.random.default_rng(3), 6_000)
    texts = ["".join(words[k : k + 100]) for k in range(0, len(words), 100)]
    cut = [counter.chunks_of(t) for t in texts]
    new = counter.learn(cut)
    assert len(new) > 5_000
    for text, chunks in zip(texts, cut, strict=True):
        want = [len(e.ids) for e in library.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]
        assert counter.prefixes(text, chunks).tolist() == want
        stored = token_counts.unpacked(*token_counts.packed(counter.prefixes(text, chunks)))
        assert stored.tolist() == want
        for budget in (0, 1, 7, 100, want[-1] - 1, want[-1], want[-1] + 1):
            assert token_counts.longest_within(stored, budget) == max(k for k, n in enumerate(want) if n <= budget)
    one_by_one = token_counts.PrefixCounter(path)
    monkeypatch.setattr(token_counts, "FEW", 1 << 30)
    one_by_one.learn(cut)
    assert one_by_one._chunks == counter._chunks


def test_full_caches(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_CHUNKS", 500)
    monkeypatch.setattr(token_counts, "PAIR_BITS", 8)
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library = token_counts.PrefixCounter(path), Tokenizer.from_file(path)
    for seed in range(3):
        texts = ["".join(invented(np.random.default_rng([seed, k]), 300)) for k in range(3)]
        cut = [counter.chunks_of(t) for t in texts]
        new = counter.learn(cut)
        assert [counter.prefixes(t, c)[-1] for t, c in zip(texts, cut, strict=True)] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        counter.forget(new)
        assert len(counter._chunks) <= 500
        assert [counter.prefixes(t, c)[-1] for t, c in zip(texts, cut, strict=True)] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


# 5 n-gram join


def brute_classes(texts, width, num, den):
    sets = {}
    for k, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
        sets[k] = {tuple(w[i : i + min(width, len(w))]) for i in range(len(w) - min(width, len(w)) + 1)} if w else set()
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    return {k: (len(sets[k]), find(k)) for k in texts}, sets


@pytest.mark.parametrize(("width", "num", "bucket"), [(4, 85, 1024), (5, 80, 3), (2, 60, 1)])
def test_ngram_join(spark, width, num, bucket, monkeypatch):
    """With small buckets also small blocks, so that components are counted in pairs of blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", bucket)
    rng = np.random.default_rng(width)
    texts = []
    passage = prose(rng, 60)
    for _ in range(12):
        base = prose(rng, int(rng.integers(20, 160))).split()
        for _ in range(int(rng.integers(1, 7))):
            w = list(base)
            for _ in range(int(rng.integers(0, 6))):
                w[int(rng.integers(len(w)))] = str(rng.choice(WORDS))
            texts.append(" ".join(w))
    texts += [passage + " " + prose(rng, int(rng.integers(1, 40))) for _ in range(10)] + ["A b", "a B", "a c", "Same Words here", "same words HERE"] + odd_texts()
    rows = ngram_join.classes(docs(spark, texts), width, num, 100, bucket=bucket, count_links=True).collect()
    want, sets = brute_classes(dict(enumerate(texts)), width, num, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    linked = lambda x, y: bool(x and y) and 100 * len(x & y) >= num * len(x | y)
    assert {r["doc_id"]: r["n_links"] for r in rows} == {a: sum(linked(x, y) for b, y in sets.items() if a != b) for a, x in sets.items()}


def test_common_ngrams(monkeypatch):
    """Rare n-grams by pairs and frequent ones by products, in slices of columns, against sets."""
    rng = np.random.default_rng(12)
    sets = [np.unique(np.concatenate([rng.integers(-500, 500, 40), rng.integers(0, 30, 25)])) for _ in range(30)]
    whole = np.array([[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets])
    every, left, right = np.arange(30), np.arange(0, 30, 3), np.arange(1, 30, 3)
    for rare, columns in ((8, 2048), (2, 5), (1, 7), (30, 2)):
        monkeypatch.setattr(ngram_join, "RARE", rare)
        monkeypatch.setattr(ngram_join, "COLUMNS", columns)
        got = ngram_join.common_ngrams(sets, every, every)
        assert (got - np.diag(np.diag(got)) == whole - np.diag(np.diag(whole))).all()
        assert (ngram_join.common_ngrams(sets, left, right) == whole[np.ix_(left, right)]).all()


def test_one_ngram_in_very_many_documents(spark):
    """10,000 different documents share a passage, and 2,000 of them are near copies: no task gets the n-gram, and no pair of the rest is looked at."""
    rng = np.random.default_rng(31)
    passage, original = prose(rng, 12), [f"{w}{k}" for k, w in enumerate(rng.choice(WORDS, 80))]
    texts = [f"{passage} {' '.join(f'{w}{k}' for w in rng.choice(WORDS, 30))}" for k in range(8_000)]
    for k in range(2_000):
        own = list(original)
        own[k % 80] = f"changed{k}"
        texts.append(passage + " " + " ".join(own))
    df = docs(spark, texts).repartition(8)
    counts = ngram_join.frequencies(ngram_join.signatures(df, 4))
    entries = ngram_join.prefixes(df, 4, 85, 100, counts)
    sizes = entries.groupBy("h", "salt").count().agg(F.max("count")).first()[0]
    assert sizes <= 1.5 * ngram_join.BUCKET
    pairs = ngram_join._first_pairs(ngram_join.shared_buckets(entries, 85, 100)).count()
    assert pairs <= 2 * entries.count()
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.classes(df, 4, 85, 100, count_links=True).collect()}
    assert {k: c for k, (c, _) in got.items()} == {k: k if k < 8_000 else 8_000 for k in range(10_000)}
    assert {got[k][1] for k in range(8_000)} == {0}
    # what two of them have in common depends on the places of their changes only, and 25 have theirs at each place
    grams = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts[8_000:8_160])]
    linked = [[100 * len(x & y) >= 85 * len(x | y) for y in grams[80:]] for x in grams[:80]]
    assert all(got[8_000 + k][1] == 25 * sum(linked[k % 80]) - linked[k % 80][k % 80] for k in range(2_000))



def test_ngram_join_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in ngram_join.classes(df).collect())
    assert got == [(-1, -1), (3, 3), (5, 3), (5, 3)]
    assert ngram_join.classes(df.limit(0)).count() == 0
    assert [r["component_id"] for r in ngram_join.classes(df.filter("doc_id = 3").withColumn("text", F.lit(None).cast("string"))).collect()] == [3]


# 6 secrets


def test_secrets(spark):
    rng = np.random.default_rng(3)
    key = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    texts = [f'{prose(rng, 9)} token = "{key(40)}" {prose(rng, 9)}' for _ in range(60)] + [f"{prose(rng, 9)} {rng.integers(10**15, 10**16)} {prose(rng, 9)}" for _ in range(60)]
    texts += ["API_KEY: abc.def=1 AKIA" + "Z9" * 9, "password=abc secret: '123456", "toſen=abcdefgh", *odd_texts(), "q" + "1f" * 3000]
    got = {r["doc_id"]: [(x["start"], x["end"], x["kind"]) for x in r["findings"]] for r in secrets.find_secrets(docs(spark, texts)).collect()}
    patterns = {"assign": re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    least = {"assign": 6, "access": 20, "hex": 24}
    for k, t in enumerate(texts):
        want = sorted((m.start(), i, m.end(), kind) for i, (kind, p) in enumerate(patterns.items()) for m in p.finditer(t or "") if len(m[2] if kind == "assign" else m[0]) >= least[kind])
        assert [s for s in got[k] if s[2] != "learned"] == [(s, e, kind) for s, _, e, kind in want]
    assert secrets.listed(got[120]).startswith("assign:0:18,access:19:")
    clean = {r["doc_id"]: r for r in secrets.redact(docs(spark, texts)).collect()}
    assert clean[0]["text"].count("[redacted]") == 1 and clean[60]["text"] == texts[60] and clean[123]["text"] is None
    assert secrets.redacted("abcdef", [(1, 3), (2, 4)], "*") == "a*ef"


def test_network_learns_and_keeps_recall():
    rng = np.random.default_rng(4)
    make = lambda letters: secrets.windows("the " + "".join(rng.choice(list(letters), 32)) + " of", 4, 36)[0]
    net = secrets.train([make("0123456789abcdef") for _ in range(200)], [make("0123456789") for _ in range(200)])
    fresh = net.probability(np.array([make("0123456789abcdef") for _ in range(100)]))
    assert net.threshold <= 1 and (fresh >= net.threshold).mean() > 0.9
    assert (net.probability(np.array([make("0123456789") for _ in range(100)])) >= net.threshold).mean() < 0.1
    assert secrets.train([], []).threshold > 1


def test_network_finds_formats_that_it_never_saw(spark):
    rng = np.random.default_rng(8)
    run = lambda letters, n: "".join(rng.choice(list(letters), n))
    low, mixed = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = [f'{prose(rng, 9)} token = "{run(low, 40)}" {prose(rng, 9)}' for _ in range(40)] + [f"{prose(rng, 9)} {rng.integers(10**15, 10**16)} {prose(rng, 9)}" for _ in range(40)]
    keys = {
        "ghp": lambda: "ghp_" + run(mixed, 36), "sk": lambda: "sk_live_" + run(mixed, 24), "google": lambda: "AIza" + run(mixed + "_-", 35), "jwt": lambda: f"eyJ{run(mixed, 30)}.eyJ{run(mixed, 50)}.{run(mixed + '_-', 43)}",
        "slack": lambda: f"xoxb-{run('0123456789', 12)}-{run('0123456789', 13)}-{run(mixed, 24)}", "account": lambda: "AccountKey=" + run(mixed + "+/", 86) + "==",
    }
    clean = {
        "slug": lambda: "-".join(rng.choice(WORDS, 5)) + "-" + run("0123456789", 4), "card": lambda: run("0123456789", 16), "uuid": lambda: "-".join(run(low, n) for n in (8, 4, 4, 4, 12)),
        "blob": lambda: f"https://git.{rng.choice(WORDS)}.org/{rng.choice(WORDS)}/blob/{run(low, 10)}/src/{'_'.join(rng.choice(WORDS, 2))}.py", "iban": lambda: "DE" + run("0123456789", 20),
        "photo": lambda: f"IMG_{run('0123456789', 8)}_{run('0123456789', 6)}.jpg", "mail": lambda: f"{rng.choice(WORDS)}.{rng.choice(WORDS)}{run('0123456789', 2)}@mail7.example.com",
    }
    planted = {name: [f"{prose(rng, 9)} {make()} {prose(rng, 9)}" for _ in range(60)] for name, make in (keys | clean).items()}
    for corpus in (texts, texts[:3], ["plain words only"], texts + planted["ghp"]):  # many findings, few, none, and unlabelled keys
        net = secrets.fit(docs(spark, corpus))
        assert net.threshold <= 1 and net.recall >= secrets.RECALL - 0.01 and net.precision > 0.98
        shares = {name: np.mean([any(kind == "learned" for *_, kind in spans) for spans in secrets.find_all(net, own)]) for name, own in planted.items()}
        assert np.mean([shares[k] for k in keys]) >= 0.9 and all(shares[k] >= 0.75 for k in keys), shares
        assert all(shares[k] <= 0.05 for k in clean), [f"{len(corpus)} {k} {shares[k]:.2f}" for k in clean if shares[k] > 0]
    got = secrets.find_secrets(docs(spark, texts + planted["sk"])).filter("doc_id >= 80").collect()
    assert np.mean([any(x["kind"] == "learned" for x in r["findings"]) for r in got]) >= 0.75
    assert secrets.find_secrets(docs(spark, texts).limit(0)).count() == 0


def test_labelled_findings_do_not_depend_on_the_dealing_of_rows(spark):
    rng = np.random.default_rng(10)
    key = "".join(rng.choice(list("0123456789abcdef"), 32))
    df = docs(spark, [f"{prose(rng, 9)} {key} {prose(rng, 9)} {k}{'7' * 16} x" for k in range(40)] + odd_texts())
    one, many = (secrets.labelled_findings(x) for x in (df.coalesce(1), df.repartition(7)))
    assert one == many and len(one[0]) == 1 and len(one[2]) > 0


def test_network_learns_from_all_findings(spark, monkeypatch):
    rng = np.random.default_rng(14)
    keys = ["".join(rng.choice(list("0123456789abcdef"), 28)) for _ in range(2300)]
    corpus = docs(spark, [f"{prose(rng, 9)} {' x '.join(keys[k : k + 23])} {prose(rng, 9)}" for k in range(0, 2300, 23)] + odd_texts())
    positive, _, words = secrets.labelled_findings(corpus)
    assert sorted(body for _, body, _ in positive) == sorted(keys) and len(words) > 0
    monkeypatch.setattr(secrets, "PART_ROWS", 900)
    made = secrets.examples(secrets.labels(corpus), 3).collect()
    shapes = len(secrets.Shapes([]).keys()) * secrets.TRAIN_GENERATED
    assert sum(r["label"] for r in made) == 2300 + 3 * shapes and {r["part"] for r in made} == {0, 1, 2}
    for part in range(3):
        own = Counter((r["label"], r["held"]) for r in made if r["part"] == part)
        assert own[1, True] == (own[1, True] + own[1, False]) // 4 and own[1, False] > shapes // 2 and own[0, True] > 0
    one, many = (secrets.fit(x) for x in (corpus.coalesce(1), corpus.repartition(7)))
    assert (one.state() == many.state()).all() and one.threshold == many.threshold
    assert secrets.RECALL - 0.01 <= one.recall <= 1 and one.precision > 0.95


def test_network_against_loops():
    rng = np.random.default_rng(12)
    net = secrets.Network()
    net.bias += rng.normal(0, 0.1, len(net.bias))
    x = np.array([secrets.windows("key = " + "aB3_" * 9 + " end", 6, 42)[0], secrets.windows("12", 0, 2)[0]])
    for row, p in zip(x, net.probability(x), strict=True):
        pooled = []
        n = len(row) - net.WIDTH + 1
        act = [[max(0.0, net.bias[f] + sum(net.kernel[k][row[at + k]][f] for k in range(net.WIDTH))) for f in range(net.FILTERS)] for at in range(n)]
        body = range(secrets.SIDE - net.WIDTH // 2, secrets.SIDE + secrets.BODY - net.WIDTH // 2)
        for places in (list(body), [at for at in range(n) if at not in body]):
            pooled += [max(act[at][f] for at in places) for f in range(net.FILTERS)]
            pooled += [sum(act[at][f] for at in places) / len(places) for f in range(net.FILTERS)]
        assert abs(p - 1 / (1 + np.exp(-(sum(a * b for a, b in zip(pooled, net.out, strict=True)) + net.out_bias[0])))) < 1e-9


def test_gradient_against_differences():
    rng = np.random.default_rng(13)
    x = np.array([secrets.windows("".join(rng.choice(list("ab1Z -"), 30)), 5, 25)[0] for _ in range(6)])
    y = np.array([0, 1, 0, 1, 1, 0.0])
    loss = lambda n: -np.mean(y * np.log(n.probability(x)) + (1 - y) * np.log(1 - n.probability(x)))
    net = secrets.Network()
    before = loss(net)
    for _ in range(20):
        net.step(x, y)
    assert loss(net) < before - 0.05
    # the first Adam step moves every used weight against the sign of its gradient
    net, other = secrets.Network(), secrets.Network()
    net.step(x, y)
    code = int(x[0][secrets.SIDE])
    for f in range(4):
        change = net.kernel[2][code][f] - other.kernel[2][code][f]
        up, down = secrets.Network(), secrets.Network()
        up.kernel[2][code][f] += 1e-5
        down.kernel[2][code][f] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        assert abs(slope) < 1e-6 or np.sign(change) == -np.sign(slope)


# 7 embeddings


def brute_vectors(rows, threshold):
    unit = {}
    for k, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            unit[k] = (label, np.array(v) / np.linalg.norm(v))
    links = defaultdict(set)
    for a, b in itertools.combinations(unit, 2):
        if unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= threshold:
            links[a].add(b)
            links[b].add(a)
    out = {}
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out[k] = (len(links[k]), min(seen))
    return out


@pytest.mark.parametrize("block", [2048, 24, 3])
def test_embeddings(spark, block):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(20):
        base = rng.normal(size=16)
        rows += [(0, (base + 0.12 * rng.normal(size=16)).round(4).tolist(), g % 2) for _ in range(8)]
    rows += [(0, rows[0][1], 0)] * 5 + [(0, None, 0), (0, rows[0][1], None), (0, [0.0] * 16, 0), (0, [float("nan")] * 16, 0), (0, [None] * 16, 0), (0, [1.0, 2.0], 0), (0, [], 0)]
    df = spark.createDataFrame([(k, v, label, 7) for k, (_, v, label) in enumerate(rows)], "vec_id long, embedding array<double>, label int, part int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, block=block).collect()}
    want = brute_vectors(rows, 0.93)
    assert got == {k: (n, c, c == k) for k, (n, c) in want.items()}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_one_id_and_without(spark):
    a, b, c = [1.0, 0.0], [0.0, 1.0], [1.0, 0.05]
    df = spark.createDataFrame([(None, a, 1, 0), (5, a, 1, 0), (5, b, 1, 0), (7, c, 1, 0), (8, c, 1, 0), (8, c, 1, 0)], "vec_id long, embedding array<double>, label int, key int")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(-1, 0, -1), (5, 0, 5), (5, 3, 5), (7, 3, 5), (8, 3, 5), (8, 3, 5)]


def test_confidence_bounds_and_stored_codes(spark):
    """Recall of the confidence bound against brute force, and codes and factors that are stored once."""
    rng = np.random.default_rng(41)
    base = rng.normal(size=(60, 64))
    rows = [(k, (base[k % 60] + 0.2 * rng.normal(size=64)).tolist(), 1) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.93).sum(1) - 1).tolist()
    for epsilon, least in ((None, 1.0), (4.0, 0.999), (1.9, 0.9)):
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df, block=128, epsilon=epsilon).collect()}
        assert all(got[k] <= want[k] for k in got)
        assert sum(got.values()) >= least * sum(want), epsilon
    one = embedding_dedup.coded(embedding_dedup.prepared(df).withColumnRenamed("vec_id", "rep"), None).filter("rep = 7").first()
    codes = embedding_dedup.Codes(unit[7:8])
    assert one["bits"] == codes.bits[0].tobytes() and abs(one["factor"] - codes.factor[0]) < 1e-6


def test_cosines_near_the_threshold_are_summed_exactly():
    left = np.array([[0.93, np.sqrt(1 - 0.93**2)]])
    right = np.array([[1.0, 0.0], [1 - 1e-12, 0.0], [0.5, 0.5]])
    (i, j), = embedding_dedup.linked(left, right, 0.93)
    assert (i.tolist(), j.tolist()) == ([0], [0])


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    errors = []
    for seed in range(40):
        codes = embedding_dedup.Codes(v, seed)
        estimate, upper = embedding_dedup.estimates(codes.rotated, codes)
        assert (upper >= v @ v.T - 1e-5).all()
        errors.append((estimate - v @ v.T)[~np.eye(60, dtype=bool)].mean())
    assert abs(np.mean(errors)) < 0.005


# 8 html


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav>Menu</nav><div class='cookie-notice'>We</div><article><h1>Head &amp; x</h1><p>One\n two<p>Three <i>it</i>.<div id=comments>troll</div><script>var a='</p>';</script></article><footer>f"
    plain = ["<body><p>Top</p><p>mine {0}</p><p>more {0}</p><p>Bottom</p>".format(k) for k in range(3)]
    rows = [(0, "http://a.example/x/1", page), (1, None, page), (2, "http://b.example/p/1", plain[0]), (3, "http://b.example/p/2", plain[1]), (4, "http://c.example/p", plain[2]), (5, "x", None), (6, "y", ""), (7, "z", "<p>a" * 5000)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df.coalesce(1)).collect()}
    assert got[0] == got[1] == "Head & x\nOne two\nThree it."
    assert got[4] == "Top\nmine 2\nmore 2\nBottom" and got[5] == got[6] == "" and got[7].count("a") == 5000
    assert {got[2], got[3]} <= {"mine 0\nmore 0", "mine 1\nmore 1", *("Top\nmine {0}\nmore {0}\nBottom".format(k) for k in range(3))}
    assert html_text.extract(df.limit(0)).count() == 0


def test_differencing_deletes_shared_lines():
    blocks = [html_text.blocks("<body><p>Top</p><p>mine {0}</p><p>more {0}</p><p>Bottom</p>".format(k)) for k in range(2)]
    assert html_text.main_text(blocks[0], blocks[1]) == "mine 0\nmore 0"
    assert html_text.main_text(blocks[0], blocks[0]) == "Top\nmine 0\nmore 0\nBottom"


def test_every_page_meets_its_neighbour(spark):
    menu = "".join(f"<div>Menu {k}</div>" for k in range(10))
    rows = [(k, f"http://a.example/p/{k:03}", f"<body>{menu}<div>own {k}</div></body>") for k in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 4, 12):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = sorted((r["page_id"], r["text"]) for r in html_text.extract(df).collect())
            assert got == [(k, f"own {k}") for k in range(12)], parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("mark", ["topnav", "commentlist", "sidebar2", "side sidebar", "pagination", "recommended", "sign-up", "site-alert", "adsbygoogle"])
def test_marked_blocks_go(mark):
    page = f'<body><div class="{mark}"><p>Away</p></div><div class="content"><p>Stays</p><div id="{mark}">Away</div><p>too</p></div><p>Doubt</p></body>'
    assert html_text.main_text(html_text.blocks(page), None) == "Stays\ntoo"


@pytest.mark.parametrize("page", [
    '<article title="The hidden valley"><p>Stays</p></article>', '<main><div class="ad-free"><p>Stays</p></div></main>', '<article><div class="social-science">Stays</div></article>',
    '<article data-note="display:none"><p>Stays</p></article>', "<article class='post share'><p>Stays</p></article>", '<article><p hidden>x<div hidden>Away</div>Stays</article>'.replace("<p hidden>x", ""),
    '<article>Stays<div style="color:red; display : none">Away</div><div aria-hidden=true>Away</div></article>',
])
def test_attributes_are_parsed(page):
    assert html_text.main_text(html_text.blocks(page), None) == "Stays"


def table_common(a, b):
    """Size of a longest common subsequence, by the full table."""
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


@pytest.mark.parametrize("wrap", ["{}", '<div class="content">{}</div>'])
def test_extract_against_full_tables(spark, wrap):
    rng = np.random.default_rng(21)
    rows, lines = [], {}
    for k in range(60):
        host = f"h{k % 3}.example"
        menu = [f"menu {host} {j}" for j in range(40) if rng.random() < 0.9]
        lines[k] = menu[:20] + [f"own {k} {j}" for j in range(5)] + menu[20:]
        rows.append((k, f"http://{host}/{'ab'[k % 2]}/{k:03}", "<body>" + wrap.format("".join(f"<p>{x}</p>" for x in lines[k])) + "</body>"))
    got = {r["page_id"]: r["text"].split("\n") for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for host in range(3):
        order = sorted((r[1], r[0]) for r in rows if r[0] % 3 == host)
        for at, (url, k) in enumerate(order):
            near = [order[j] for j in (at - 1, at + 1) if 0 <= j < len(order)]
            _, other = max(near, key=lambda n: next((j for j, (x, y) in enumerate(zip(url, n[0], strict=True)) if x != y), 99))  # noqa: B023
            assert len(lines[k]) - len(got[k]) == table_common(lines[k], lines[other])
            assert [x for x in got[k] if x.startswith("own")] == [f"own {k} {j}" for j in range(5)]
            assert not set(got[k]) & set(lines[other])


def test_template_of_forty_lines():
    page = lambda k: html_text.blocks("<body>" + "".join(f"<div>Menu {j}</div>" for j in range(40)) + "".join(f"<p>own {k} {j}</p>" for j in range(5)))
    assert html_text.main_text(page(0), page(1)) == "\n".join(f"own 0 {j}" for j in range(5))


def test_pages_against_another_parser():
    """Pages of the test tables: blocks inside the article element, by the parser of the standard library."""
    import os
    from html.parser import HTMLParser

    import pyarrow.parquet as pq

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.blocks = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            if tag not in ("b", "a"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            if tag not in ("b", "a"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.depth:
                self.blocks[-1] += data

    for html in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        parser = Article()
        parser.feed(html)
        want = "\n".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x)
        assert html_text.main_text(html_text.blocks(html), None) == want


@pytest.mark.parametrize("name", ["addresses", "navy", "contents-of-the-day", "headers-and-hats", "postal", "searching"])
def test_like_names_stay(name):
    assert html_text.main_text(html_text.blocks(f'<article><div class="{name}">Stays</div></article>'), None) == "Stays"


def test_longest_common_against_table():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = (list(rng.choice(list("abcd"), int(rng.integers(0, 9)))) for _ in range(2))
        found = html_text.longest_common(a, b)
        assert len(found) == table_common(a, b)
        rest = iter(b)
        assert all(a[k] in rest for k in sorted(found))


def test_longest_common_by_halves(monkeypatch):
    """The other way of aligning, on all of the same cases."""
    monkeypatch.setattr(html_text, "MANY_PAIRS", 0)
    test_longest_common_against_table()


def test_many_equal_lines_are_aligned_quickly():
    """Long tables of the same few rows: seconds and memory must not follow the number of pairs of equal rows, 10^9 here."""
    import time

    began = time.process_time()
    same = ["row"] * 50_000
    assert len(html_text.longest_common(same, same)) == 50_000
    assert len(html_text.longest_common(["a", *same, "b"], ["c", *same[:40_000], "d"])) == 40_000
    assert time.process_time() - began < 2
    rng = np.random.default_rng(6)
    a, b = (list(rng.choice(list("pq"), n)) for n in (20_000, 19_000))
    began = time.process_time()
    found = sorted(html_text.longest_common(a, b))
    rest = iter(b)
    assert len(found) > 14_000 and all(a[k] in rest for k in found)
    assert time.process_time() - began < 20


def test_a_teaser_does_not_replace_the_text():
    page = '<article><p>teaser</p></article><nav>menu</nav><div class="story"><p>long body text</p><p>Share this</p></div>'
    assert html_text.main_text(html_text.blocks(page), None) == "teaser\nlong body text\nShare this"
    near = html_text.blocks('<div class="story"><p>another one</p><p>Share this</p></div>')
    assert html_text.main_text(html_text.blocks(page), near) == "teaser\nlong body text"
    longer = '<article><p>a much longer text of an article</p></article><div class="story"><p>more stories</p></div>'
    assert html_text.main_text(html_text.blocks(longer), None) == "a much longer text of an article"


# 9 packing


def test_packing(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(9)
    texts = [prose(rng, int(rng.integers(1, 900))) for _ in range(80)] + odd_texts() + ["ΑΣ İ don't, It's (x) ab.,. É"]
    rows = packing.pack_documents(docs(spark, texts)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= total / 4096 + 2
    assert packing.pack_documents(docs(spark, texts).limit(0)).count() == 0


def test_packing_edges(spark):
    df = spark.createDataFrame([(None, "a b", 1)] + [(4, "a b", 1)] * 3 + [(5, None, 1)], "doc_id long, text string, start int")
    rows = packing.pack_documents(df).collect()
    assert sorted((r["doc_id"] or -1, r["length"]) for r in rows) == [(-1, 3), (4, 3), (4, 3), (4, 3), (5, 1)]
    assert sorted(r["offset"] for r in rows) == [0, 3, 6, 9, 12] and len({r["sequence_id"] for r in rows}) == 1


def test_word_ids_equal_the_library():
    library, ours = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(17)
    alphabet = list("abIKés'’ ..,;!?-\"()[]<|>~`^_ \n\t0179ßµªİıΣςσжЖ漢ǅK\u0307\u0301\u0338\u037e\u1fef\x1c\x85\xa0🙂") + ["<|endoftext|>", "<|startoftext|>", "<|", "'s", "İ.", "İ"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(1, 14)))) for _ in range(20_000)] + ["BİRİ.", "İ,", "bİ", "İ̇.", "É.", "K."]
    for text, got in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_first_fit_decreasing_against_scan():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = rng.integers(1, 100, int(rng.integers(1, 60)))
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room: list[int] = []
        for k in np.argsort(-lengths, kind="stable"):
            b = next((i for i, r in enumerate(room) if r >= lengths[k]), len(room))
            if b == len(room):
                room.append(100)
            assert (bins[k], offsets[k]) == (b, 100 - room[b])
            room[b] -= lengths[k]


# 10 decontamination


def brute_hits(text, items, window):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    w, hit, found = split(text), set(), set()
    at = defaultdict(list)
    for size in {min(window, len(split(t))) for t in items.values()} - {0}:
        for i in range(len(w) - size + 1):
            at[tuple(w[i : i + size])].append(i)
    for item, t in items.items():
        own = split(t)
        size = min(window, len(own))
        for i in range(len(own) - size + 1) if own else ():
            for p in at.get(tuple(own[i : i + size]), ()):
                hit.update(range(p, p + size))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize(("block_bytes", "most_terms"), [(16_000_000, 10_000), (200, 10_000), (200, 25)])
def test_decontamination(spark, block_bytes, most_terms):
    rng = np.random.default_rng(7)
    items = {k: prose(rng, 25) for k in range(12)} | {20: "kelka vintor", 21: "", 22: None, 23: "É-é 漢"}
    texts = [prose(rng, 60) + (" " + items[k % 12] if k % 3 == 0 else "") + " " + prose(rng, 10) for k in range(20)]
    texts += ["x Kelka, VINTOR! y kelka vintor", "É é 漢", " ".join(items[0].split()[3:14]).upper(), *odd_texts()]
    bench = spark.createDataFrame([(k, t, 1) for k, t in items.items()] + [(3, items[3], 1)], "item_id long, text string, doc_id int")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in decontamination.contamination(docs(spark, texts), bench, block_bytes=block_bytes, most_terms=most_terms).collect()}
    assert got == {k: brute_hits(t, items, 10) for k, t in enumerate(texts)}


def test_search_in_chunks_and_against_scan():
    rng = np.random.default_rng(16)
    text = rng.choice(list("abcde"), 400)
    terms = {x.encode(): k for k, x in enumerate("abcdef")}
    tests = decontamination.TestWindows([(k, " ".join(rng.choice(list("abcdef"), int(rng.integers(1, 6)))).encode()) for k in range(40)], terms, 3)
    tests.rarest_first(np.array([9, 1, 5, 5, 7, 0]))
    stream = np.array([terms[x.encode()] for x in text])
    order = np.argsort(stream, kind="stable")
    present, counts = np.unique(stream, return_counts=True)
    shard = decontamination.Shard(present, counts, order.astype("<u4").tobytes(), len(text) + 3)
    want = {(k, at) for k, w in enumerate(tests.windows) for at in range(len(text) - tests.lengths[k] + 1) if list(stream[at : at + tests.lengths[k]]) == list(w[: tests.lengths[k]])}
    for most in (1, 7, 10**6):
        which, start = decontamination.search(shard, tests, most=most)
        assert len(which) == len(want) and set(zip(which.tolist(), start.tolist(), strict=True)) == want


def test_proximity_against_sql(spark):
    import duckdb

    from knitwork.llm import catalogue

    rng = np.random.default_rng(18)
    items = [(k, " ".join(rng.choice(WORDS, int(rng.integers(1, 14))))) for k in range(15)]
    texts = []
    for k in range(60):
        own = items[k % 15][1].split()
        for _ in range(int(rng.integers(0, 4))):
            own.insert(int(rng.integers(len(own) + 1)), "x")
        if k % 3 == 0:
            own = list(rng.permutation(own))
        texts.append(" ".join([*rng.choice(WORDS, 4), *own, *rng.choice(WORDS, 4)]))
    got = decontamination.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), slop=decontamination.SLOP)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = con.sql(catalogue.OP10_SQL)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert got.filter("n_near > 0 AND NOT contaminated").count() > 0


def test_documents_without_id_or_repeated(spark):
    item = "a1 a2 a3 a4 a5 a6 a7 a8 a9 b1"
    df = spark.createDataFrame([(None, item, 1), (None, "x", 1), (4, item, 1), (4, item, 1), (4, None, 1)], "doc_id long, text string, items int")
    got = decontamination.contamination(df, spark.createDataFrame([(1, item, 2)], "item_id long, text string, row_key int")).collect()
    assert sorted((r["doc_id"] or -1, r["n_hit"], r["items"]) for r in got) == [(-1, 0, []), (-1, 10, ["1"]), (4, 0, []), (4, 10, ["1"]), (4, 10, ["1"])]


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    df = docs(spark, ["alpha x beta gamma", "gamma beta alpha", "nothing"])
    near = {r["doc_id"]: (r["contaminated"], r["n_near"] > 0) for r in decontamination.contamination(df, bench, slop=4).collect()}
    assert near == {0: (False, True), 1: (False, True), 2: (False, False)}
    assert [r["contaminated"] for r in decontamination.contamination(df, bench.limit(0)).collect()] == [False] * 3
    assert decontamination.contamination(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("block_bytes", [16_000_000, 70])
def test_items_without_id_against_sql(spark, block_bytes):
    import duckdb

    from knitwork.llm import catalogue

    items, texts = [(None, "alpha beta gamma"), (None, "delta eta"), (5, "beta gamma"), (6, "zeta")], ["x alpha beta gamma delta eta", "delta eta", "zeta", "none"]
    got = decontamination.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), slop=decontamination.SLOP, block_bytes=block_bytes)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = con.sql(catalogue.OP10_SQL)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert {r["doc_id"]: r["items"] for r in got.collect()} == {0: ["5"], 1: [], 2: ["6"], 3: []}


def test_query_returns_proximity_matches(spark, tmp_path):
    from knitwork.llm import catalogue

    item = "a1 a2 a3 a4 a5 a6 a7 a8 a9 b1"
    # the last two hold the item only together, which is no match
    texts = [item, item.replace("a5", "x a5"), "none", "y a1 a2 a3 a4 a5", "a6 a7 a8 a9 b1 y"]
    docs(spark, texts).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["contaminated"], r["n_near"]) for r in catalogue.op10_decontamination(spark, str(tmp_path)).collect()}
    assert got == {0: (True, 1), 1: (False, 1), 2: (False, 0), 3: (False, 0), 4: (False, 0)}
    df, bench = docs(spark, ["a1 a2", "a3"]).coalesce(1), spark.createDataFrame([(1, "a1 a2 a3")], "item_id long, text string")
    assert [r["n_near"] for r in decontamination.contamination(df, bench, window=3, slop=4).collect()] == [0, 0]


# pipeline


def test_executors_give_heap_back(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    assert ngram_join.classes(docs(spark, ["a b c d e f", "a b c d e f", "x"])).count() == 3
    assert full() >= before + 4


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(12)
    texts = [prose(rng, 60) + (" idiot " if k % 5 == 0 else " ") + prose(rng, 30) for k in range(150)]
    bench = prose(rng, 30)
    texts += [prose(rng, 20) + " " + bench + " " + prose(rng, 20), texts[1], texts[2] + " more", None, "", f'{prose(rng, 30)} token = "{"ab12" * 10}"']
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(None, "no id at all here", None, None, None), (1, texts[1], "en", "s", 9)]
    root = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(150)], "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{root}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, root).write.parquet(f"{root}/out/{name}")
        now = spark.read.parquet(f"{root}/out/{name}")
        seen[name] = now
    left = Counter(r["doc_id"] for r in seen["secret_scan"].collect())
    assert left == Counter([k for k in range(150) if k % 5] + [153, 154, 155, None])
    assert seen["secret_scan"].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    changed = seen["secret_scan"].filter("doc_id = 155").first()
    assert "[redacted]" in changed["text"] and changed["n_chars"] == len(changed["text"])
    assert {r["doc_id"] for r in now.select("doc_id").collect()} == set(left)
    assert corpus_pipeline.run(spark, root).count() == now.count()


def test_pipeline_edges(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join(WORDS)
    rows = [(3, words), (5, words + " end"), (5, "quite " + " ".join(reversed(WORDS))), (7, words), (9, "x"), (9, "x")]
    for name, own in (("some", rows), ("none", [])):
        root = f"file://{tmp_path}/{name}"
        spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in own], kinds).write.parquet(f"{root}/documents.parquet")
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    # of two texts with one id, the copy goes and the other stays; of repeated rows, one
    kept = corpus_pipeline.keep_one_of_each_group(spark, spark.read.parquet(f"file://{tmp_path}/some/documents.parquet"), f"file://{tmp_path}/some")
    assert sorted((r["doc_id"], r["text"][:5]) for r in kept.collect()) == [(3, words[:5]), (5, "quite"), (9, "x")]
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
