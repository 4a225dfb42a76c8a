"""Decoded content and length of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.functions import text as X


def lower_headers(responses: DataFrame) -> DataFrame:
    """Header names in lower case, as every operator here expects them."""
    return responses.withColumn("headers", X.lower_keys(F.col("headers")))


def decode_content(responses: DataFrame) -> DataFrame:
    """Add content_type, charset and content. All null unless the code is 200.

    An empty body leaves content_type with its parameters and no charset."""
    raw = F.coalesce(X.header(F.col("headers"), "content-type"), F.lit("text/plain"))
    has_body = F.coalesce(F.octet_length("body"), F.lit(0)) > 0
    ok = F.col("code") == 200
    named = responses.withColumns(
        {
            "content_type": F.when(ok, F.when(has_body, X.media_type(raw)).otherwise(raw)),
            "charset": F.when(ok & has_body, X.charset(raw)),
        }
    )
    body = F.when(ok & has_body, F.col("body"))
    return named.withColumn("content", X.decoded(body, F.col("charset")))


def with_html(responses: DataFrame, out: str = "html") -> DataFrame:
    """Add the body as text whatever the code, for link extraction.

    The charset is the one that the page itself declares, else the header's; an unknown one reads as
    UTF-8. Where decode_content has already given content in that charset, it is taken."""
    raw = F.coalesce(X.header(F.col("headers"), "content-type"), F.lit("text/plain"))
    own = X.declared_charset(F.col("body"))
    named = responses.withColumn("_charset", F.coalesce(own, X.charset(raw), F.lit("utf-8")))
    body, known = F.col("body"), []
    if {"content", "charset"} <= set(responses.columns):
        same = F.col("content").isNotNull() & (F.lower("charset") == F.lower("_charset"))
        known = [F.when(same, F.col("content"))]
        body = F.when(F.coalesce(same, F.lit(False)), F.lit(None)).otherwise(F.col("body"))
    plain = F.make_valid_utf8(F.col("body").cast("string"))
    return named.withColumn(out, F.coalesce(*known, X.decoded(body, F.col("_charset")), plain)).drop("_charset")


def with_raw_len(responses: DataFrame) -> DataFrame:
    """Add raw_len: the content-length header when it is a whole number, else the body's length."""
    announced = F.regexp_extract(X.header(F.col("headers"), "content-length"), r"^\s*([+-]?\d+)\s*$", 1)
    return responses.withColumn(
        "raw_len",
        F.coalesce(announced.try_cast("bigint"), F.octet_length("body").cast("bigint"), F.lit(0).cast("bigint")),
    )
