"""The queue of urls to fetch, as tables keyed by url and host."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webframe.functions import url as U
from webframe.session import shuffle_partitions
from webframe.settings import HOST_BATCH, PRIORITY

SALTS = 64


def restrict_links(
    links: DataFrame, domains: DataFrame, follow_links: bool = True, mode: str = "domains", url: str = "url"
) -> DataFrame:
    """Links whose host is exactly in the allow-list; none when links are not followed.

    In 'internet' mode an empty allow-list restricts nothing."""
    if mode not in ("domains", "internet"):
        raise ValueError(f"unknown mode {mode!r}")
    if not follow_links:
        return links.filter(F.lit(False))
    if mode == "internet" and domains.isEmpty():
        return links
    allowed = domains.select(F.col("domain").alias("_domain"))
    return links.join(allowed, U.host(F.col(url)) == F.col("_domain"), "left_semi")


def candidate_urls(candidates: DataFrame) -> DataFrame:
    """One row per candidate url: whether any of its rows is forced, and when it was first added."""
    at = F.col("added_at") if "added_at" in candidates.columns else F.current_timestamp()
    return candidates.groupBy("url").agg(
        F.max(F.coalesce("force", F.lit(False))).alias("force"), F.min(at).alias("added_at")
    )


def queue_rows(fresh: DataFrame, keep_force: bool = False) -> DataFrame:
    """New urls (url, force, added_at) as rows of the frontier."""
    return fresh.select(
        "url",
        U.host(F.col("url")).alias("host"),
        F.lit(PRIORITY).alias("priority"),
        (F.col("force") if keep_force else F.lit(False)).alias("force"),
        "added_at",
    )


def frontier_add(
    frontier: DataFrame, seen: DataFrame, candidates: DataFrame, keep_force: bool = False
) -> DataFrame:
    """The frontier with new candidates: forced ones always, others unless seen.

    Candidates are reduced to one row per url before any join, so a link found on very many
    pages costs one row per task. Queued urls keep their row. `force` is not stored with the
    queue unless keep_force is set."""
    done = seen.select(F.col("url").alias("_seen"))
    fresh = candidate_urls(candidates).join(done, (F.col("url") == F.col("_seen")) & ~F.col("force"), "left_anti")
    return frontier.unionByName(queue_rows(fresh.join(frontier.select("url"), "url", "left_anti"), keep_force))


def mark_done(frontier: DataFrame, seen: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move processed urls, whatever their outcome, from the frontier to the seen set."""
    urls = done.select("url").distinct()
    return frontier.join(urls, "url", "left_anti"), seen.unionByName(urls.join(seen, "url", "left_anti"))


def next_batch(frontier: DataFrame, n: int = HOST_BATCH) -> DataFrame:
    """The first n urls of each host, by priority then url, both descending. Adds rn.

    Spark keeps n rows per host and task before the shuffle. Beyond the n up to which it does
    that, a first pass over salted hosts takes its place; it grows with the cluster, and leaves n
    rows per host and salt to the second."""
    spark = frontier.sparkSession
    order = [F.col("priority").desc(), F.col("url").desc()]
    rn = F.row_number()
    if n > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        salts = max(SALTS, shuffle_partitions(spark) // 16)
        salted = frontier.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(salts)))
        first = Window.partitionBy("host", "_salt").orderBy(*order)
        frontier = salted.withColumn("_rn", rn.over(first)).filter(F.col("_rn") <= n).drop("_salt", "_rn")
    return frontier.withColumn("rn", rn.over(Window.partitionBy("host").orderBy(*order))).filter(F.col("rn") <= n)


def fetch_plan(batch: DataFrame, concurrency: int = 2) -> DataFrame:
    """Waves of at most `concurrency` fetches per host, hosts in rotation. Takes next_batch's rows."""
    wave = F.floor((F.col("rn") - 1) / concurrency).cast("int")
    return batch.withColumn("wave", wave).orderBy("wave", "host", "rn")


def queue_summary(frontier: DataFrame, done: DataFrame, response_times: DataFrame) -> DataFrame:
    """Per host: queued urls, crawled total and mean response time, sorted without a leading www."""
    queued = frontier.groupBy("host").agg(F.count("*").alias("count"))
    crawled = done.groupBy("host").agg(F.count("*").alias("total"))
    both = queued.join(crawled, "host", "full").join(response_times.select("host", "ave_resp"), "host", "left")
    return both.select(
        "host",
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
        F.coalesce("total", F.lit(0).cast("bigint")).alias("total"),
        F.coalesce("ave_resp", F.lit(0.0)).alias("ave_resp"),
    ).orderBy(F.regexp_replace("host", r"^www\.", ""), "host")


def purge_host(frontier: DataFrame, host: str) -> DataFrame:
    """The frontier without one host's urls; the seen set keeps them."""
    return frontier.filter(~F.col("host").eqNullSafe(host))
