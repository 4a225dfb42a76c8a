"""Operator-edited tables: allow-list and robots rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rules_listing(custom_rules: DataFrame, collation: str | None = None) -> DataFrame:
    """Rules sorted by site, ord, path and flag; `collation` such as 'UNICODE' sorts as a locale does."""

    def text(name):
        return F.collate(F.col(name), collation) if collation else F.col(name)

    return custom_rules.orderBy(text("site"), "ord", text("path"), "flag")


def _apply(table: DataFrame, changes: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The table after changes (seq, action 'add' or 'delete', key, values) in order of seq.

    A deletion removes what came before it; of several additions the first holds, as the key is
    unique. Changes are reduced to one row per key before the joins."""
    deleted = F.max(F.when(F.col("action") == "delete", F.col("seq"))).alias("_deleted")
    last = changes.groupBy(key).agg(deleted).filter("_deleted IS NOT NULL")
    kept = table.join(last, key, "left_anti")
    added = (
        changes.filter("action = 'add'")
        .join(last, key, "left")
        .filter("_deleted IS NULL OR seq > _deleted")
        .groupBy(key)
        .agg(F.min_by(F.struct(*values), "seq").alias("_v"))
        .select(key, *[F.col(f"_v.{v}").alias(v) for v in values])
    )
    return kept.unionByName(added.join(kept.select(key), key, "left_anti"))


def apply_domain_changes(domains: DataFrame, changes: DataFrame) -> DataFrame:
    """Allow-list after additions and deletions by domain.

    An added domain is enabled and has no delay of its own, unless the change says otherwise."""

    def given(name):
        return F.col(name) if name in changes.columns else F.lit(None)

    full = changes.withColumns(
        {
            "enabled": F.coalesce(given("enabled").cast("boolean"), F.lit(True)),
            "crawl_delay": given("crawl_delay").cast("double"),
        }
    )
    return _apply(domains, full, "domain", ["enabled", "crawl_delay"])


def apply_rule_changes(custom_rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Robots rules after additions (ord defaults to now, in seconds) and deletions by id."""
    full = changes.withColumns(
        {
            "flag": F.coalesce(F.col("flag").cast("boolean"), F.lit(False)),
            "ord": F.coalesce(F.col("ord"), F.unix_timestamp()).cast("bigint"),
        }
    )
    return _apply(custom_rules, full, "id", ["site", "ord", "flag", "path"])
