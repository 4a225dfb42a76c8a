"""Url parts, link resolution and robots.txt addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.functions import url as U


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add scheme, host and path."""
    c = F.col(url)
    return df.withColumns({"scheme": U.scheme(c), "host": U.host(c), "path": U.path(c)})


def resolve_urls(df: DataFrame, base: str = "base", href: str = "href", out: str = "link") -> DataFrame:
    """Resolve `href` against `base`; keep rows whose result is an http(s) url, without fragment."""
    parts = df.withColumn("_base", U.base_parts(F.col(base)))
    return (
        parts.withColumn(out, U.crawlable(U.resolve(F.col("_base"), F.col(href))))
        .drop("_base")
        .filter(F.col(out).isNotNull())
    )


def robots_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """The distinct robots.txt addresses of the urls; the port is dropped."""
    c = F.col(url)
    return df.select(U.robots_url(c).alias("robots_url"), U.host(c).alias("host")).distinct()
