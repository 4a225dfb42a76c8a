"""A corpus pipeline: quality rules, exact and near deduplication, redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return
the columns of documents. Rows with null texts have no words and go in the first stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.llm import exact_dedup, near_copies, packing, pii, quality_rules
from webframe.llm.shared import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judged(docs).filter("kept").select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text."""
    return exact_dedup.drop_copies(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per near-duplicate component, that with the smallest id.

    Links are those of `near_copies`: five-word shingles with a Jaccard similarity of 0.8 or more, not the four words
    and four bits of op5.
    The ids that go are far fewer than those that stay, so texts are joined with them; they are read from a file,
    so that Spark broadcasts them where they are few. An id on several rows goes only if all of its rows
    are copies of others; rows without an id go where a row of their component has one."""
    found = near_copies.near_copies(docs)
    stays = F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = found.groupBy("doc_id").agg(stays.alias("stays")).filter("not stays").select(F.col("doc_id").alias("_gone"))
    return docs.join(stored(gone, "near-copies"), F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and secrets replaced by their kind; n_chars counts the new text.

    Numbers that run together are replaced one by one, so that no text keeps a span of a base kind."""
    model, threshold = pii.fit(pii.candidates(docs))
    out = pii.redacted(pii.personal_data(docs, model, threshold, secrets=True))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of bounded length."""
    import public_tokenizers

    return packing.packed(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", simhash_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Fingerprints, trees and tokenizers are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
