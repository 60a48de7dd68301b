"""From raw documents to token ids, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transit_tables.llm import byte_bpe, mixing, ngram_jaccard, quality, secrets
from transit_tables.llm.common import fresh, save


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels outside the held-out part."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where(~quality.held_out()))
    (score,) = fresh(docs, "score")
    return quality.score(docs, model, out_col=score).where(F.col(score) >= quality.ACCEPT).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, ties by hashes of text and row. Nulls come last.

    Groups are made of texts, by a 64-bit hash of doc_id and text, so distinct texts
    with one doc_id stay, and copies without a doc_id go.
    """
    key, row = fresh(docs, "text_key", "row_key")
    keyed = docs.withColumns({key: F.xxhash64("doc_id", "text"), row: F.xxhash64(*docs.columns)})
    groups = ngram_jaccard.jaccard_components(keyed.select(F.col(key).alias("key"), "text"), id_col="key").select("key", "component_id").distinct()
    narrow = keyed.select("doc_id", F.col(key).alias("key"), F.col(row).alias("row"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key", "row")).alias("b")
    kept = narrow.join(groups, "key").groupBy("component_id").agg(best).select(F.col("b.key").alias(key), F.col("b.row").alias(row))
    return keyed.join(kept, [key, row], "left_semi").dropDuplicates([key]).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars counted again."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row: doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    return byte_bpe.digests(spark, docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: The classifier, the set join and the merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs, "stage")
    return docs
