"""Crawl log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.settings import LOG_KEEP


def crawl_log(results: DataFrame, at: str | None = None) -> DataFrame:
    """One LOG row per finished url."""
    text = F.when(F.col("code").isNull(), F.concat(F.lit("NOT Crawled "), F.col("url"))).otherwise(
        F.concat(F.lit("Crawled "), F.col("code").cast("string"), F.lit(" "), F.col("url"))
    )
    return results.select((F.col(at) if at else F.current_timestamp()).alias("ts"), text.alias("message"))


def seed_log(seeds: DataFrame, at: str | None = None) -> DataFrame:
    """One LOG row per added seed."""
    text = F.concat(F.lit("Added "), F.col("url"))
    return seeds.select((F.col(at) if at else F.current_timestamp()).alias("ts"), text.alias("message"))


def log_tail(log: DataFrame, since_token: int = 0, keep: int = LOG_KEEP, shown: int | None = None) -> DataFrame:
    """Of the newest `keep` entries those after the caller's token (epoch ms), oldest first.

    `shown` keeps only the last so many of them, as the log view does. Entries of one instant
    are ordered by message."""
    newest = log.orderBy(F.col("ts").desc(), F.col("message").desc()).limit(keep)
    micros = F.unix_micros("ts")
    after = newest.filter(F.floor((micros + 500) / 1000) > since_token)
    if shown is not None:
        after = after.orderBy(F.col("ts").desc(), F.col("message").desc()).limit(shown)
    return after.orderBy("ts", "message").select(
        (micros / 1_000_000).alias("tval"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
        "message",
    )
