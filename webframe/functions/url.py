"""URL parts and relative-reference resolution as native Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: RFC 3986 component split.
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
NETLOC_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)"
LAST_SEGMENT_PARAMS = r";[^/]*$"
DOT_SEGMENT = r"(^|/)\.\.?(/|$)"
# authority with its '//', path, query and non-empty fragment of a reference
REFERENCE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#$|(#.+))?"
# references that resolve to themselves, or to themselves at the root of the base
PLAIN_URL = r"^https?://[^/?#;\[\]\x00-\x20]+(?:/[^?#;\x00-\x20]*)?(?:\?[^#\t\r\n]+)?$"
PLAIN_ROOT = r"^/(?!/)(?!(?:[^?#]*/)?\.)[^?#;\t\r\n]*(?:\?[^#\t\r\n]+)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, NETLOC_PATH, 1)


def host(url: Column) -> Column:
    """netloc without its port; a netloc with more than one ':' is kept whole."""
    return F.regexp_replace(netloc(url), r"^([^:]*):[^:]*$", "$1")


def path(url: Column) -> Column:
    """Path without query, fragment and the last segment's parameters; never empty."""
    raw = F.regexp_extract(url, NETLOC_PATH, 2)
    bare = F.regexp_replace(raw, LAST_SEGMENT_PARAMS, "")
    return F.when(bare == "", "/").otherwise(bare)


def robots_url(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url), F.lit("/robots.txt"))


def full_target(url: Column) -> Column:
    """path;params?query with percent escapes decoded, except %2F.

    Escapes that are no escapes are kept, '+' stays '+'."""
    raw = F.regexp_extract(url, NETLOC_PATH, 2)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]+)", 1)
    lead = F.when(raw == "", "/").when(raw.startswith(";"), F.concat(F.lit("/"), raw)).otherwise(raw)
    text = F.concat(_drop_empty_params(lead), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    safe = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    safe = F.regexp_replace(safe, r"%2[fF]", "%252F")
    return F.url_decode(F.replace(safe, F.lit("+"), F.lit("%2B")))


def _drop_empty_params(p: Column) -> Column:
    return F.regexp_replace(p, r"(^|/)([^/;]*);$", "$1$2")


def base_parts(base: Column) -> Column:
    """What resolving against `base` needs, worked out once per page."""
    raw = F.regexp_extract(base, NETLOC_PATH, 2)
    return F.struct(
        base.alias("whole"),
        scheme(base).alias("scheme"),
        netloc(base).alias("netloc"),
        _drop_empty_params(raw).alias("path"),
        # folder of the base path, up to its last slash
        F.regexp_extract(F.regexp_replace(raw, LAST_SEGMENT_PARAMS, ""), r"^(.*/)", 1).alias("folder"),
        F.regexp_extract(base, r"^[^?#]*\?([^#]*)", 1).alias("query"),
    )


def _remove_dots(p: Column) -> Column:
    segments = F.split(p, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(p.rlike(r"(^|/)\.\.?$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.array_join(tail, "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def _question(query: Column) -> Column:
    return F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))


def resolve(base: Column, href: Column) -> Column:
    """`href` resolved against an http(s) `base_parts` struct by RFC 3986, as urllib's urljoin does.

    Most links are whole urls or start at the root, and one match settles them; the others
    are taken apart. Null when a bracketed host is malformed."""
    return (
        F.when(href.rlike(PLAIN_URL), href)
        .when(href.rlike(PLAIN_ROOT), F.concat(base["scheme"], F.lit("://"), base["netloc"], href))
        .when(href == "", base["whole"])
        .otherwise(
            _let(
                F.regexp_replace(href, r"^[\x00-\x20]+|[\t\r\n]", ""),
                lambda clean: _let(
                    F.struct(
                        scheme(clean).alias("scheme"),
                        F.regexp_extract(clean, REFERENCE, 1).alias("authority"),
                        F.regexp_extract(clean, REFERENCE, 2).alias("raw"),
                        F.regexp_extract(clean, REFERENCE, 3).alias("query"),
                        F.regexp_extract(clean, REFERENCE, 4).alias("fragment"),
                    ),
                    lambda ref: _join(base, href, ref),
                ),
            )
        )
    )


def _join(base: Column, href: Column, ref: Column) -> Column:
    tail = F.concat(_question(ref["query"]), ref["fragment"])
    root = F.concat(base["scheme"], F.lit("://"), base["netloc"])
    params = F.regexp_extract(ref["raw"], r"(;[^/]+)$", 1)

    def relative(p: Column) -> Column:
        in_folder = F.concat(F.when(base["folder"] == "", "/").otherwise(base["folder"]), p)
        merged = F.when(p.startswith("/"), p).otherwise(F.regexp_replace(in_folder, "/+", "/"))
        return _let(merged, lambda m: F.when(m.rlike(DOT_SEGMENT), _remove_dots(m)).otherwise(m))

    def at_authority(p: Column) -> Column:
        slash = F.when((p != "") & ~p.startswith("/"), "/").otherwise("")
        return F.concat(base["scheme"], F.lit(":"), ref["authority"], slash, p, tail)

    same_page_query = F.when(ref["query"] == "", base["query"]).otherwise(ref["query"])
    return (
        F.when((ref["scheme"] != "") & (ref["scheme"] != base["scheme"]), href)
        .when(ref["authority"].contains("[") != ref["authority"].contains("]"), None)
        .when(F.length(ref["authority"]) > 2, _let(_drop_empty_params(ref["raw"]), at_authority))
        .when(ref["raw"].isin("", ";"), F.concat(root, base["path"], _question(same_page_query), ref["fragment"]))
        .otherwise(
            F.concat(_let(F.regexp_replace(ref["raw"], LAST_SEGMENT_PARAMS, ""), lambda p: F.concat(root, relative(p))),
                     params, tail)
        )
    )


def crawlable(url: Column) -> Column:
    """Cut the fragment; null unless the result is an http or https url."""
    cut = F.substring_index(url, "#", 1)
    return F.when(cut.startswith("http://") | cut.startswith("https://"), cut)
