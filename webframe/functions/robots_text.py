"""A robots.txt text as nested arrays, by native expressions (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed directive names, in the order in which a token is tried against them.
AGENT_TOKENS = ("useragent", "user-agent")
DIRECTIVES = ("allow", "disallow", "sitemap", "crawl-delay")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def pattern(path: Column) -> Column:
    """Regular expression for a rule path: '*' is any text, a final '$' anchors the end."""
    anchored = path.endswith("$")
    body = F.when(anchored, F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    literal = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(
        F.lit("^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.when(anchored, "$").otherwise("")
    )


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _kind(token: Column, lenient_tokens: bool) -> Column:
    """Which directive a token stands for. Lenient: any part of the name will do."""
    out = F.when(token.isin(*AGENT_TOKENS), "agent")
    for name in DIRECTIVES:
        out = out.when(F.contains(F.lit(name), token) if lenient_tokens else token == name, name)
    return out.otherwise("other")


def directives(content: Column, lenient_tokens: bool = True) -> Column:
    """array<struct<kind, value>> of the lines that hold a ':' before any '#'."""
    lines = F.transform(F.split(content, "\n"), lambda l: F.regexp_replace(_strip(l), "(?s)#.*$", ""))
    return F.transform(
        F.filter(lines, lambda l: l.contains(":")),
        lambda l: F.struct(
            _kind(F.lower(_strip(F.substring_index(l, ":", 1))), lenient_tokens).alias("kind"),
            _strip(F.replace(F.regexp_replace(l, "(?s)^[^:]*:", ""), F.lit("\t"), F.lit(" "))).alias("value"),
        ),
    )


def group_starts(lines: Column) -> Column:
    """Positions (0-based) where a group of rules starts: the first line, and each user-agent
    line that does not follow another one."""
    n = F.size(lines)
    positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(
        positions,
        lambda i: (i == 0) | ((F.get(lines, i)["kind"] == "agent") & (F.get(lines, i - 1)["kind"] != "agent")),
    )


def groups(lines: Column, starts: Column) -> Column:
    """array<struct<group_no, agents, rules, crawl_delay>> in file order."""
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(lines)))

    def group(start: Column, g: Column) -> Column:
        own = F.slice(lines, start + 1, F.get(ends, g) - start)
        agents = F.filter(own, lambda d: (d["kind"] == "agent") & (d["value"] != ""))
        paths = F.filter(own, lambda d: d["kind"].isin("allow", "disallow") & (d["value"] != ""))
        delays = F.filter(own, lambda d: (d["kind"] == "crawl-delay") & d["value"].rlike(NUMBER))
        return F.struct(
            (g + 1).alias("group_no"),
            F.transform(agents, lambda d: d["value"]).alias("agents"),
            F.transform(
                paths,
                lambda d, i: F.struct(
                    (i + 1).alias("rule_no"),
                    (d["kind"] == "allow").alias("allow"),
                    d["value"].alias("path"),
                    pattern(d["value"]).alias("pattern"),
                ),
            ).alias("rules"),
            F.try_element_at(delays, F.lit(-1))["value"].try_cast("double").alias("crawl_delay"),
        )

    return F.transform(starts, group)


def sitemap(lines: Column) -> Column:
    """The last sitemap named in the file."""
    found = F.filter(lines, lambda d: d["kind"] == "sitemap")
    return F.try_element_at(found, F.lit(-1))["value"]
