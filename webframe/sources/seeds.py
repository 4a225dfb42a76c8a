"""Seed urls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.functions import url as U
from webframe.settings import PRIORITY


def ingest_seeds(urls: DataFrame, strict_quirk: bool = True) -> tuple[DataFrame, DataFrame]:
    """Seeds as forced frontier rows, and their hosts as allow-list rows.

    Text that does not start with http:// gets it in front, also https:// urls unless
    strict_quirk is False."""
    text = F.col("url")
    known = text.startswith("http://")
    if not strict_quirk:
        known = known | text.startswith("https://")
    full = urls.select(F.when(known, text).otherwise(F.concat(F.lit("http://"), text)).alias("url")).distinct()
    rows = full.select(
        "url",
        U.host(F.col("url")).alias("host"),
        F.lit(PRIORITY).alias("priority"),
        F.lit(True).alias("force"),
        F.current_timestamp().alias("added_at"),
    )
    domains = rows.select(F.col("host").alias("domain")).distinct().select(
        "domain", F.lit(True).alias("enabled"), F.lit(None).cast("double").alias("crawl_delay")
    )
    return rows, domains
