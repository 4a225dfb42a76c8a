"""The operators on whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.llm import (
    bpe, class_lm, exact_dedup, html_paths, packing, pii, quality_rules, ranked_search, simhash, suffix_dedup, warc, weak_quality, whitening,
)
from webframe.llm.shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def warc_archives(spark: SparkSession, sf: str) -> DataFrame:
    raw, folder = new_folder(spark, "warc-raw"), new_folder(spark, "warc")
    warc.write_archives(warc.records(_table(spark, sf, "pages")), raw)
    warc.normalise(spark, raw, folder)
    read = warc.read_records(warc.read_index(spark, folder), folder)
    whole = F.col("record_type") == "response"
    return read.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf, "documents")).drop("spans")


def personal_data(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    model, threshold = pii.fit(pii.candidates(docs))
    found = pii.personal_data(docs.select("doc_id", "text"), model, threshold)

    def n(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.sha2(pii.joined(F.filter("spans", lambda s: s["base"])), 256)
    return found.select(
        "row.doc_id", *[n(k) for k in pii.BASE], base.alias("base_sha256"), pii.joined(F.col("spans")).alias("spans")
    )


def html_main_text(spark: SparkSession, sf: str) -> DataFrame:
    found = html_paths.extract(_table(spark, sf, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf, "documents"))


def weak_label_quality(spark: SparkSession, sf: str) -> DataFrame:
    return weak_quality.classified(_table(spark, sf, "documents"))


def tree_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(_table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN, check=True)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def adaptive_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    found = quality_rules.judged(docs, carry=["doc_id"])
    return found.select("row.doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def exact_dedup_groups(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf, "documents"))


def first_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(packing.pieces(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search.ranked(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def class_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return class_lm.scored(_table(spark, sf, "documents"))


def embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_warc": warc_archives,
    "op2_suffix_array_dedup": suffix_array_dedup,
    "op3_personal_data": personal_data,
    "op4_html_main_text": html_main_text,
    "op5_simhash_near_dedup": simhash_near_dedup,
    "op6_weak_label_quality": weak_label_quality,
    "op7_tree_bpe": tree_bpe,
    "op8_quality_rules": adaptive_quality_rules,
    "op9_exact_dedup": exact_dedup_groups,
    "op10_packing": first_fit_packing,
    "op11_ranked_search": lexical_search,
    "op12_class_lm": class_lm_scores,
    "op13_whitening": embedding_whitening,
}
