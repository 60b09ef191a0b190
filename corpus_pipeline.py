"""Corpus pipeline: toxic documents go, one of each near-duplicate group stays,
contaminated documents go, secrets are blanked out, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. ``run`` writes every stage to the shared folder
and reads it back as the next one's input.

Defined cases: null texts count as empty and stay until they are packed as one
end-of-text id; null ids stay, since they are in no group; repeated rows are a
group of copies; an empty table passes through; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knitwork.llm import decontamination, ngram_join, packing, secrets, toxicity
from knitwork.llm.common import bounded_batches, give_back, read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    bounded_batches(spark)
    give_back(spark)
    scored = toxicity.toxicity(docs, read(spark, sf_dir, "labels"), "toxicity_score_")
    return scored.filter(F.col("toxicity_score_") < toxicity.THRESHOLD).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of five-word shingle sets linked at 0.8; of several rows with that id, one."""
    bounded_batches(spark)
    classes = ngram_join.classes(docs, width=5, num=80, den=100)
    kept = classes.filter(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("kept_id_")).agg(F.min("text_key").alias("kept_text_"), F.count("*").alias("rows_"))
    kept = stored(kept, "kept-documents")
    same = (F.col("doc_id") == F.col("kept_id_")) & (F.xxhash64("text") == F.col("kept_text_"))
    single = docs.join(kept.filter("rows_ = 1"), same, "left_semi")
    several = docs.join(kept.filter("rows_ > 1"), same, "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(several).unionByName(docs.filter(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. A document without an id goes by its text."""
    bounded_batches(spark)
    give_back(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 62)))
    keyed = docs.select(key.alias("doc_id"), "text")
    found = decontamination.contamination(keyed, read(spark, sf_dir, "benchmark"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("bad_id_")).distinct()
    return docs.join(bad, key == F.col("bad_id_"), "left_anti")


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what looks like a secret replaced."""
    bounded_batches(spark)
    give_back(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 4096 tokens, a row per piece of a document."""
    bounded_batches(spark)
    give_back(spark)
    # workers still hold what earlier stages keep, and serve later runs, so fewer words here, and only within a task
    return packing.pack_documents(docs, cache_words=300_000, keep=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", blank_secrets),
    ("packing", pack),
]

#: A trained model decides in two stages, which SQL cannot express; tests hold a fixture with the documents that each stage has to keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
