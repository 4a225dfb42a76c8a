"""Link and meta tags of an HTML text by native regular expressions.

One left-to-right scan takes comments, script and style elements as units, so tags
inside them are not seen. All repetition is possessive or lazy: no backtracking."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_ATTRS = rf"""(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+|=)*+"""
TAGS = (
    r"(?is)<(?:!--(?:-?>|.*?(?:--!?>|\z))"
    r"|script(?=[\s/>]).*?(?:</script(?=[\s/>])|\z)"
    r"|style(?=[\s/>]).*?(?:</style(?=[\s/>])|\z)"
    rf"|((?:a|meta)(?=[\s/]){_ATTRS}>?))"
)
ENTITY = r"(?s)&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+;)|[^&]++|&"
_ENTITIES = "\x01".join(f"&{name}\x02{text}" for name, text in sorted(html5.items()) if name.endswith(";"))


def link_tags(html: Column) -> Column:
    """The texts of all closed <a ...> and <meta ...> tags after their '<', in document order.

    An unclosed tag takes in the rest of the page, as browsers do, which also keeps the scan linear."""
    return F.filter(F.regexp_extract_all(html, F.lit(TAGS), F.lit(1)), lambda t: t.endswith(">"))


def is_tag(tag: Column, name: str) -> Column:
    """Whether one of link_tags' texts is an 'a' or a 'meta' tag: the first letter tells."""
    return tag.startswith(name[0]) | tag.startswith(name[0].upper())


def raw_attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute `name` as it is written, quotes included; '' when absent."""
    skip = rf"(?:[\s/]++|(?!{name}\s*+=)[^\s/>=][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+|=)*+"
    return F.regexp_extract(tag, rf"(?is)^[a-z]++{skip}{name}\s*+=\s*+({_VALUE})", 1)


def unquoted(raw: Column) -> Column:
    quoted = raw.startswith('"') | raw.startswith("'")
    return F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)


def _character(code: Column) -> Column:
    bad = code.isNull() | (code < 1) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.when(~bad, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def unescape(text: Column) -> Column:
    """Character references replaced by their characters: numbers of any length, with or without a ';',
    and the names of HTML 5 that end in one."""
    names = F.str_to_map(F.lit(_ENTITIES), F.lit("\x01"), F.lit("\x02"))

    def one(t: Column) -> Column:
        # leading zeros go first; what is longer than any character's number then stays as it is
        decimal = F.regexp_extract(t, r"^&#0*+([0-9]{1,7});?$", 1)
        hexadecimal = F.regexp_extract(t, r"^&#[xX]0*+([0-9a-fA-F]{1,6});?$", 1)
        return (
            F.when(decimal != "", F.coalesce(_character(decimal.try_cast("bigint")), t))
            .when(hexadecimal != "", F.coalesce(_character(F.conv(hexadecimal, 16, 10).try_cast("bigint")), t))
            .when(t.startswith("&"), F.coalesce(F.try_element_at(names, t), t))
            .otherwise(t)
        )

    decoded = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), one), "")
    return F.when(text.contains("&"), decoded).otherwise(text)


def hrefs(tags: Column) -> Column:
    """href of every <a> that has one and is not marked rel=nofollow; duplicates kept.

    One pass per step, so that each expression is worked out once per tag."""
    anchors = F.filter(tags, lambda t: is_tag(t, "a"))
    raw = F.transform(
        anchors, lambda t: F.struct(raw_attribute(t, "href").alias("href"), raw_attribute(t, "rel").alias("rel"))
    )
    kept = F.filter(raw, lambda r: (r["href"] != "") & (F.lower(unquoted(r["rel"])) != "nofollow"))
    values = F.transform(F.transform(kept, lambda r: unquoted(r["href"])), unescape)
    return F.filter(values, lambda h: h != "")


def nofollow(tags: Column) -> Column:
    """True when a robots meta tag lists exactly 'nofollow' (list items are not trimmed)."""
    metas = F.filter(tags, lambda t: is_tag(t, "meta"))
    raw = F.transform(
        metas, lambda t: F.struct(raw_attribute(t, "name").alias("name"), raw_attribute(t, "content").alias("content"))
    )
    return F.exists(
        raw,
        lambda r: (F.lower(unquoted(r["name"])) == "robots")
        & F.array_contains(F.split(F.lower(unquoted(r["content"])), ","), "nofollow"),
    )
