"""Robots exclusion as joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webframe.functions import robots_text as R
from webframe.functions import url as U
from webframe.operators.blocks import block_window, earlier_blocks, in_blocks
from webframe.session import checkpointed, written
from webframe.settings import DENY_ALL_ROBOTS, ROBOT_NAME

# Rules in one list; sites of the operator with more different ones are indexed.
RULES_PER_LIST = 64


def robots_status_policy(robots_txt: DataFrame, mode: str = "pipeline") -> DataFrame:
    """Replace content by what the response code makes of it.

    'standalone': 2xx is read, 401 and 403 deny all, anything else allows all.
    'pipeline': only a 200 is read, anything else allows all."""
    text = F.coalesce(F.col("content"), F.lit(""))
    code = F.col("code")
    if mode == "standalone":
        policy = F.when(code.between(200, 299), text).when(code.isin(401, 403), DENY_ALL_ROBOTS)
    elif mode == "pipeline":
        policy = F.when(code == 200, text)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return robots_txt.withColumn("content", policy.otherwise(""))


def _parsed(robots_txt: DataFrame, lenient_tokens: bool) -> DataFrame:
    lines = robots_txt.withColumn("_lines", R.directives(F.col("content"), lenient_tokens))
    starts = lines.withColumn("_starts", R.group_starts(F.col("_lines")))
    each = starts.withColumn("_group", F.explode_outer(R.groups(F.col("_lines"), F.col("_starts"))))
    return each.filter(F.col("_group").isNotNull())


def parse_robots(robots_txt: DataFrame, lenient_tokens: bool = True) -> DataFrame:
    """ROBOTS_RULES rows. Works within each file's row: no shuffle.

    A group without rules keeps one row with a null rule_no, since it can still be the group
    that applies."""
    each = _parsed(robots_txt, lenient_tokens).withColumn("_rule", F.explode_outer("_group.rules"))
    return each.select(
        "robots_url", "host", "_group.group_no", "_group.agents", "_rule.rule_no", "_rule.allow",
        "_rule.path", "_rule.pattern", "_group.crawl_delay",
    )


def robots_meta(robots_txt: DataFrame, lenient_tokens: bool = True) -> DataFrame:
    """Crawl delay of each group and the sitemap of its file."""
    return _parsed(robots_txt, lenient_tokens).select(
        "robots_url", "host", "_group.group_no", "_group.agents", "_group.crawl_delay",
        R.sitemap(F.col("_lines")).alias("sitemap"),
    )


def select_ruleset(rules: DataFrame, robot_name: str = ROBOT_NAME) -> DataFrame:
    """The rules of the first group in each file that names '*' or the robot."""
    ours = F.exists("agents", lambda a: (a == "*") | (F.lower(a) == robot_name.lower()))
    order = Window.partitionBy("robots_url").orderBy("group_no")
    return rules.filter(ours).withColumn("_rank", F.rank().over(order)).filter("_rank = 1").drop("_rank")


def custom_ruleset(custom_rules: DataFrame) -> DataFrame:
    """The operator's own rules of each site, numbered by ord (then id).

    A site may have any number: rules are dealt in ranges of site, ord and id, numbered within each range, and each range adds
    what earlier ones hold of its site (a row per site and range)."""
    order = ["ord", "id"]
    kept = custom_rules.filter(F.col("path") != "").withColumn("_site", F.coalesce("site", F.lit("\0")))
    local = checkpointed(in_blocks(kept, "_site", order).withColumn("_k", F.row_number().over(block_window("_site", order))))
    totals = local.groupBy("_site", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_n").over(earlier_blocks("_site")), F.lit(0))).filter("_before > 0")
    numbered = local.join(before.select("_site", "_block", "_before"), ["_site", "_block"], "left")
    return numbered.select(
        "site",
        (F.col("_k") + F.coalesce("_before", F.lit(0))).cast("int").alias("rule_no"),
        F.coalesce(F.col("flag"), F.lit(False)).alias("allow"),
        "path",
        R.pattern(F.col("path")).alias("pattern"),
    )


@dataclass(frozen=True)
class RuleLists:
    """Rules gathered so that a url meets those that may match it in joins.

    `sites` has a row per site: files (robots_url and rules, one per scheme), whose lists are no longer than those files, and own,
    the operator's rules where a site has up to RULES_PER_LIST different ones. Those of other sites are in
    `index`, by site, head and tail (see `_index`), with `lengths`, the lengths of heads and tails that a site's rules have.
    Both are None where no site has so many."""

    sites: DataFrame
    index: DataFrame | None = None
    lengths: DataFrame | None = None


def _cut(rules: DataFrame) -> DataFrame:
    """Rules with their path cut at its wildcards: the head that a target starts with, the parts that follow
    it in order, and for a path ending in '$' the tail with which the target ends."""
    anchored = F.col("path").endswith("$")
    body = F.when(anchored, F.substring("path", F.lit(1), F.length("path") - 1)).otherwise(F.col("path"))
    cut = rules.withColumn("_cut", F.split(body, r"\*")).withColumn("_last", F.size("_cut"))
    parts = F.filter(F.slice("_cut", F.lit(2), F.greatest(F.col("_last") - F.when(anchored, 2).otherwise(1), F.lit(0))), lambda x: x != "")
    new = {
        "head": F.get("_cut", F.lit(0)),
        "parts": F.when(F.col("_last") > 1, parts),
        "tail": F.when(anchored, F.when(F.col("_last") > 1, F.get("_cut", F.col("_last") - 1)).otherwise("")),
    }
    return cut.withColumns(new).drop("_cut", "_last")


def _gathered(rules: DataFrame, *keys: str) -> DataFrame:
    rule = F.struct("rule_no", "allow", "head", "parts", "tail")
    return rules.groupBy(*keys).agg(F.sort_array(F.collect_list(rule)).alias("rules"))


def _index(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules by a hash of their site, head and tail: a target can only match those whose head it starts with and whose tail its
    first line ends with. Many rules of one head and tail are held in lists of RULES_PER_LIST numbers. Also the lengths that occur
    in each site."""
    at = {"_head": F.length("head"), "_tail": F.coalesce(F.length("tail"), F.lit(0))}
    keyed = rules.withColumns(at | {"list": F.floor((F.col("rule_no") - 1) / RULES_PER_LIST)})
    key = F.xxhash64("site", "_head", "_tail", "head", F.coalesce("tail", F.lit("")))
    index = _gathered(keyed.withColumn("key", key), "site", "key", "list")
    lengths = keyed.groupBy("site").agg(F.collect_set(F.struct("_head", "_tail")).alias("lengths"))
    return index, lengths


def rule_lists(ruleset: DataFrame, custom: DataFrame | None = None, keep: bool = False) -> RuleLists:
    """Gather rules for repeated use; `keep` writes the gathered rules to the shared folder."""
    hold = (lambda df: written(df, "rules")) if keep else (lambda df: df)
    of_file = _gathered(_cut(ruleset.filter("rule_no IS NOT NULL")), "robots_url")
    sites = of_file.groupBy(U.host(F.col("robots_url")).alias("site")).agg(
        F.collect_list(F.struct("robots_url", "rules")).alias("files")
    )
    if custom is None:
        none = F.get("files", F.lit(0))["rules"]
        return RuleLists(hold(sites.withColumn("own", F.when(F.lit(False), none))))
    # of equal rules of a site only the first can decide
    one = _cut(custom.filter("site IS NOT NULL")).groupBy("site", "head", "parts", "tail").agg(
        F.min_by("allow", "rule_no").alias("allow"), F.min("rule_no").alias("rule_no")
    )
    large = one.groupBy("site").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > RULES_PER_LIST).select("site")
    own = _gathered(one.join(large, "site", "left_anti"), "site").withColumnRenamed("rules", "own")
    sites = hold(sites.join(own, "site", "full"))
    if large.isEmpty():
        return RuleLists(sites)
    index, lengths = _index(one.join(large, "site", "left_semi"))
    return RuleLists(sites, hold(index), hold(lengths))


def _match(rules: str, target: str) -> Column:
    """The first of `rules` that matches column `target`, null when none does.

    Each part is looked for from where the one before it ended, which is exact for this kind of pattern and
    takes time in proportion to the target per part, whatever the rule. A wildcard takes any text but a
    line feed, and '$' also stands before a final one."""
    line = f"substring_index({target}, '\\n', 1)"
    after = f"""aggregate(r.parts, length(r.head) + 1,
        (p, s) -> if(p = 0, 0, coalesce(nullif(locate(s, {line}, p), 0) + length(s), 0)))"""
    ends = f"({target} = {line} OR {target} = concat({line}, '\\n'))"
    return F.expr(
        f"""try_element_at(filter({rules}, r -> startswith({target}, r.head) AND CASE
            WHEN r.parts IS NULL THEN r.tail IS NULL OR {target} = r.head OR {target} = concat(r.head, '\\n')
            WHEN r.tail IS NULL THEN {after} > 0
            ELSE {ends} AND endswith({line}, r.tail) AND {after} BETWEEN 1 AND length({line}) - length(r.tail) + 1
            END), 1)"""
    )


def robots_allowed(
    urls: DataFrame,
    rules: RuleLists | DataFrame,
    custom: DataFrame | None = None,
    target: str = "path",
    url: str = "url",
) -> DataFrame:
    """Add allowed: the first matching robots rule and the first matching custom rule both allow.

    No match allows. target 'full' matches path;params?query, percent-decoded, instead of the
    path. `rules` are gathered lists, or the output of select_ruleset (with `custom` that of
    custom_ruleset)."""
    lists = rules if isinstance(rules, RuleLists) else rule_lists(rules, custom)
    c = F.col(url)
    match target:
        case "path":
            text = U.path(c)
        case "full":
            text = U.full_target(c)
        case _:
            raise ValueError(f"unknown target {target!r}")
    keyed = urls.withColumns({"_robots_url": U.robots_url(c), "_site": U.host(c), "_target": text})
    sites = lists.sites.select(F.col("site").alias("_site"), F.col("files").alias("_files"), F.col("own").alias("_own"))
    out = keyed.join(sites, "_site", "left")
    by_file = _match("try_element_at(filter(_files, f -> f.robots_url = _robots_url), 1).rules", "_target")["allow"]
    out = out.withColumns({"_by_file": by_file, "_by_site": _match("_own", "_target")["allow"]}).drop("_files", "_own")
    extra = ["_robots_url", "_site", "_target", "_by_file", "_by_site"]
    by_site = F.col("_by_site")
    if lists.index is not None:
        # urls only, without the lists they met
        indexed = _indexed_verdicts(keyed.select(c.alias("_indexed_url"), "_site", "_target"), lists)
        out = out.join(indexed, c == F.col("_indexed_url"), "left")
        by_site = F.coalesce(by_site, F.col("_indexed"))
        extra += ["_indexed_url", "_indexed"]
    yes = F.lit(True)
    return out.withColumn("allowed", F.coalesce(F.col("_by_file"), yes) & F.coalesce(by_site, yes)).drop(*extra)


def _indexed_verdicts(urls: DataFrame, lists: RuleLists) -> DataFrame:
    """Verdict of the rules of sites with very many, one row per url that any decides.

    A url asks for the prefixes and suffixes of its target of the lengths that occur, and meets the rules of just these."""
    lengths = lists.lengths.select(F.col("site").alias("_site"), F.explode("lengths").alias("_at"))
    asked = urls.distinct().join(lengths, "_site").withColumn("_line", F.substring_index("_target", "\n", 1))
    head, tail = F.substring("_target", F.lit(1), F.col("_at._head")), F.right("_line", F.col("_at._tail"))
    fits = (F.length("_target") >= F.col("_at._head")) & (F.length("_line") >= F.col("_at._tail"))
    asked = asked.filter(fits).withColumn("key", F.xxhash64("_site", "_at._head", "_at._tail", head, tail)).drop("_at", "_line")
    met = asked.join(lists.index.withColumnRenamed("site", "_site"), ["_site", "key"])
    first = met.withColumn("_rule", _match("rules", "_target")).filter("_rule IS NOT NULL")
    return first.groupBy("_indexed_url").agg(F.min_by("_rule.allow", "_rule.rule_no").alias("_indexed"))
