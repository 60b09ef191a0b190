"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knitwork.llm import alignment, chat, decontamination, embedding_dedup, html_text, langid, ngram_join, packing, secrets, token_counts, toxicity, vantage_trees, vector_codes
from knitwork.llm.common import fold, read


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read(spark, sf_dir, "conversations"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.toxicity(docs, read(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    prototypes = langid.fit(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", "text"), prototypes).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.within(token_counts.prefix_table(read(spark, sf_dir, "documents")), token_counts.LIMIT)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_counts.LIMIT).alias("over_limit"), "n_chars_within")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(read(spark, sf_dir, "documents"), width=4, num=85, den=100, count_links=True).drop("text_key")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("findings", lambda x: x["kind"] != "learned")
    number = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans")
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), slop=decontamination.SLOP)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    coded = vector_codes.with_label_errors(codes).withColumn("codebooks_sha256", F.lit(vector_codes.codebooks_digest(books)))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage_trees.neighbours(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place, role, text FROM conversations
), whole AS (
  SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY place) AS turns FROM placed GROUP BY conv_id
), one AS (SELECT min(conv_id) AS conv_id, n_turns, turns, count(*) AS n_logged FROM whole GROUP BY n_turns, turns
), begun AS (SELECT DISTINCT turns[1:k] AS turns FROM whole, unnest(range(1, n_turns)) AS t(k))
SELECT conv_id, n_turns, n_logged,
  array_to_string(list_transform(turns, lambda x: '<|' || coalesce(x.r, '') || '|>' || chr(10) || coalesce(x.t, '')), chr(10)) AS rendered
FROM one WHERE NOT EXISTS (SELECT 1 FROM begun WHERE begun.turns = one.turns)
"""

OP5_SQL = r"""
WITH RECURSIVE fold AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g
  FROM fold, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 85 * (s.n + t.n - c)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = d.doc_id LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

OP7_SQL = r"""
WITH RECURSIVE vecs AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), ok AS (SELECT vec_id, label, v, len(v) AS d FROM vecs WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.d = y.d AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.93
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT e.vec_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(r.least, e.vec_id)) AS component_id, least(e.vec_id, coalesce(r.least, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON r.a = e.vec_id
"""

OP10_SQL = r"""
WITH fold AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), tests AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS words
  FROM tests, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM win), distinct_win AS (SELECT DISTINCT size, words FROM win
), spots AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM fold, sizes, unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size
), hits AS (SELECT spots.doc_id, spots.size, spots.i, spots.words FROM spots JOIN distinct_win USING (size, words)
), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + size)) AS t(p) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits JOIN win USING (size, words)) GROUP BY doc_id
), terms AS (SELECT size, words, k, string_split(words, ' ')[k] AS term FROM distinct_win, unnest(range(1, size + 1)) AS t(k)
), places AS (
  SELECT doc_id, p, term FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS term FROM fold) WHERE term IN (SELECT term FROM terms)
), freq AS (SELECT term, count(*) AS c FROM places GROUP BY term
), rarest AS (
  SELECT * FROM (SELECT size, words, k, term, row_number() OVER (PARTITION BY size, words ORDER BY coalesce(c, 0), k) AS r FROM terms LEFT JOIN freq USING (term)) WHERE r = 1
), starts AS (SELECT size, words, doc_id, p - k AS start FROM rarest JOIN places USING (term)
), near AS (
  SELECT doc_id, count(*) AS n_near FROM (
    SELECT s.doc_id, s.size, s.words, s.start FROM starts s JOIN terms t USING (size, words) JOIN places o ON o.doc_id = s.doc_id AND o.term = t.term
    WHERE o.p BETWEEN s.start + t.k - {slop} * CAST(t.k <> (SELECT k FROM rarest x WHERE x.size = t.size AND x.words = t.words) AS INT)
      AND s.start + t.k + {slop} * CAST(t.k <> (SELECT k FROM rarest x WHERE x.size = t.size AND x.words = t.words) AS INT)
    GROUP BY ALL HAVING count(DISTINCT t.k) = s.size
  ) GROUP BY doc_id
)
SELECT f.doc_id, CAST(coalesce(len(f.w), 0) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(d.n_items, 0) AS BIGINT) AS n_items, coalesce(d.items_sha256, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated, CAST(coalesce(n.n_near, 0) AS BIGINT) AS n_near
FROM fold f LEFT JOIN covered c USING (doc_id) LEFT JOIN found d USING (doc_id) LEFT JOIN near n USING (doc_id)
"""

OP10_SQL = OP10_SQL.replace("{slop}", str(decontamination.SLOP))


def _op11_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Assignments a0, a1, ... and codebooks b0, b1, ... in turn; sums of products of integers are exact in doubles here."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, p, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT r, parts.p, x, e, list_dot_product(x, x) + list_dot_product(c, c) - 2 * list_dot_product(x, c) AS d FROM parts JOIN b{k} ON parts.p = b{k}.p) GROUP BY r, p
)""")
        if k < rounds:
            steps.append(f"""m{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS m FROM a{k}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY p, e, i) GROUP BY p, e
), b{k + 1} AS MATERIALIZED (SELECT b{k}.p, b{k}.e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} ON b{k}.p = m{k}.p AND b{k}.e = m{k}.e)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, vec_id, p, v[p * (len(v) // {vector_codes.PARTS}) + 1 : (p + 1) * (len(v) // {vector_codes.PARTS})] AS x FROM kept, unnest(range({vector_codes.PARTS})) AS t(p)
), first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {vector_codes.ENTRIES}
), b0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN first USING (vec_id)
), {", ".join(steps)}
, coded AS (
  SELECT r, string_agg(lower(printf('%02x', CAST(e AS BIGINT))), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r
), digest AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{rounds}, unnest(range(1, len(c) + 1)) AS t(i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest
"""


OP11_SQL = _op11_sql()

OP12_SQL = """
WITH vecs AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM vecs q JOIN vecs c ON q.r <> c.r WHERE q.vec_id % 20 = 0
), ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_chat, op2_toxicity, op3_language_id, op4_token_counts, op5_ngram_join, op6_secrets, op7_embedding_dedup, op8_html, op9_packing, op10_decontamination, op11_vector_codes, op12_vantage_trees, op13_alignment]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": OP1_SQL, "op5_ngram_join": OP5_SQL, "op7_embedding_dedup": OP7_SQL, "op10_decontamination": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_vantage_trees": OP12_SQL}
