"""Exact deduplication by 128-bit content hash.

Rows are grouped by the hash together with the text itself: the hash decides the partition, and the
aggregation compares the bytes, so texts that collide stay apart. Partial aggregation leaves one row
per task and distinct text, so a group of any size never meets in one place. The members then find
their group by two hashes, in a join of narrow rows whose large keys adaptive execution splits.

Null texts count as empty, empty texts are equal to each other, null ids never win over others.
Rows that repeat an id and its text all count in the group size and share the verdict of their id.
Only the id and the text are read; other columns may have any name and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_key(text: Column) -> Column:
    """The 128-bit hash of a text."""
    return F.unhex(F.md5(text.cast("binary")))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("key", content_key(F.col("text")))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """Per row: doc_id, keep_id (the `keep` id, min or max, among equal texts), group_size, kept, text_sha256."""
    rows = _keyed(docs, doc_id, text)
    best = {"min": F.min, "max": F.max}[keep]
    groups = rows.groupBy("key", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("key", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    members = rows.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256"))
    found = members.join(groups, ["key", "text_sha256"])
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _ordered(name: str, kind: T.DataType) -> Column:
    """The column, or its JSON where values of its type have no order (maps, at any depth)."""
    column = F.col(f"`{name}`")
    return F.to_json(F.struct(column)) if '"map"' in kind.json() else column


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One whole row per distinct text, that with the largest id; of rows that repeat it, the largest by the other columns
    (maps by their JSON)."""
    rest = [f for f in docs.schema if f.name not in (doc_id, text)]
    given = F.col(text).isNotNull().alias("_given")
    row = F.struct(F.col(doc_id), *[F.col(f"`{f.name}`") for f in rest], given)
    order = [_ordered(f.name, f.dataType) for f in rest]
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), row.alias("_row"), F.struct(F.col(doc_id), *order, given).alias("_order"))
    plain = all('"map"' not in f.dataType.json() for f in rest)
    best = F.max("_row") if plain else F.max_by("_row", "_order")
    groups = rows.groupBy(content_key(F.col("_text")).alias("_key"), "_text").agg(best.alias("_row"))
    kept = F.when(F.col("_row._given"), F.col("_text")).alias(text)
    return groups.select(*[kept if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
