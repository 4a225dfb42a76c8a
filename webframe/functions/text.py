"""Response headers and body decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed names under which servers write the two charsets decoded natively.
UTF8 = ("utf-8", "utf8")
LATIN1 = ("iso-8859-1", "iso8859-1", "latin-1", "latin1")


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; values of names that then coincide are joined by ','."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(
        names,
        F.transform(
            names,
            lambda n: F.array_join(
                F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"]), ","
            ),
        ),
    )


def header(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def media_type(content_type: Column) -> Column:
    return F.substring_index(content_type, ";", 1)


def charset(content_type: Column) -> Column:
    """Charset of a content-type text: 'utf-8' unless named, null when the parameter has no '='."""
    blank = F.lit(" \t\r\n\f\v")
    parts = F.split(content_type, ";")
    named = F.filter(
        F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.lower(F.btrim(p, blank)).startswith("charset")
    )
    first = F.try_element_at(named, F.lit(1))
    value = F.btrim(F.try_element_at(F.split(first, "="), F.lit(2)), blank)
    return F.when(first.isNull() | (value == ""), "utf-8").otherwise(value)


def _decode_other(body: pd.Series, name: pd.Series) -> pd.Series:
    def one(raw, codec):
        if raw is None or codec is None:
            return None
        try:
            return bytes(raw).decode(codec, errors="ignore")
        except (LookupError, ValueError):
            return None

    return pd.Series([one(b, n) for b, n in zip(body, name)], dtype=object)


META = r"""(?i)<meta\s[^<>]*?\bcharset\s*+=\s*+["']?\s*+([a-z0-9_.:-]++)"""


def declared_charset(body: Column) -> Column:
    """The charset that a page's own first meta declaration names, null without one.

    A page in which the declaration can be read as it stands is not UTF-16, whatever it says."""
    name = F.lower(F.regexp_extract(body.cast("string"), META, 1))
    return F.when(name.startswith("utf-16"), "utf-8").when(name != "", name)


def decoded(body: Column, name: Column) -> Column:
    """Text of `body` in the named charset, undecodable bytes dropped; null for an unknown charset.

    UTF-8 and Latin-1 bodies are decoded in the JVM. Bad bytes of UTF-8 become U+FFFD there and are then
    removed, so only bodies in other charsets, or with both bad bytes and that character, are sent to Python."""
    low = F.lower(name)
    as_text = body.cast("string")
    utf8 = low.isin(*UTF8)
    clean = utf8 & F.is_valid_utf8(as_text)
    mendable = utf8 & ~F.contains(body, F.lit(b"\xef\xbf\xbd"))
    latin = low.isin(*LATIN1)
    other = ~F.coalesce(clean | mendable | latin, F.lit(True))
    # made for each use: one that has been used holds a JVM object, and a module that holds it could not go to workers any more
    decode_other = F.pandas_udf(_decode_other, StringType())
    return (
        F.when(clean, as_text)
        .when(mendable, F.replace(F.make_valid_utf8(as_text), F.lit("\ufffd"), F.lit("")))
        .when(latin, F.decode(body, "ISO-8859-1"))
        .otherwise(decode_other(F.when(other, body), F.when(other, name)))
    )
