"""The crawl loop as a fixpoint over a link table."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from webframe.operators.frontier import restrict_links
from webframe.operators.robots import RuleLists, robots_allowed, rule_lists
from webframe.session import held, new_folder, remove_folder, shuffle_partitions, shuffled_in, written
from webframe.settings import CrawlSettings

# A page's links are spread over buckets in runs of this many.
RUN = 100_000
# A round's tasks and files are as many as the buckets, so there is one for so many rows (see `_buckets`).
ROWS_PER_BUCKET = 200_000
# From this round on, and then whenever the number of rounds has doubled, links of pages that were
# reached before are left behind: late rounds find few pages and should not read all links for them.
REWRITE_FROM = 4
# The rounds' tables of reached urls are merged whenever so many have been written.
MERGE_EVERY = 16
REACHED = "url string, allowed boolean, round int"


def _buckets(spark: SparkSession, *tables: DataFrame) -> int:
    """As many as the largest table needs, at most the number of shuffle partitions.

    A crawl has many rounds that find little. One that deals it to all shuffle partitions costs as much as there are of
    them, and with larger tables there are more of both, rounds and partitions."""
    rows = max(t.count() for t in tables)
    return min(shuffle_partitions(spark), rows // ROWS_PER_BUCKET + 1)


def _write_bucketed(links: DataFrame, folder: str, tables: list[str]) -> DataFrame:
    """Links (src, run, dst) as a table bucketed by (src, run), so that no round has to shuffle them."""
    spark = links.sparkSession
    n = shuffle_partitions(spark)
    tables.append(_table("links"))
    (
        links.repartition(n, "src", "run")
        .write.bucketBy(n, "src", "run")
        .sortBy("src", "run")
        .option("path", f"{folder}/{tables[-1]}")
        .saveAsTable(tables[-1])
    )
    return spark.table(tables[-1])


def _bucketed_edges(edges: DataFrame, folder: str, tables: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Edges written once, in buckets of whole runs.

    `run` counts every RUN links of a page, so a page with very many links lies in many buckets.
    Also gives the number of runs of the pages with more than one (None if there are none): at
    most links / RUN rows, found by a filter that skips all files without such pages."""
    run = F.floor(F.col("pos") / RUN).cast("int").alias("run")
    bucketed = _write_bucketed(edges.select("src", run, "dst"), folder, tables)
    long_pages = bucketed.filter("run > 0").groupBy("src").agg((F.max("run") + 1).alias("runs"))
    return bucketed, None if long_pages.isEmpty() else written(long_pages, "long-pages")


def _runs(front: DataFrame, long_pages: DataFrame | None) -> DataFrame:
    """The runs (src, run) of the pages to expand.

    Exploded even where every page has one run: a constant would drop out of the join's keys, and
    with it the use of the buckets."""
    last = F.lit(0)
    if long_pages is not None:
        front, last = front.join(long_pages, "src", "left"), F.coalesce("runs", F.lit(1)) - 1
    return front.select("src", F.explode(F.sequence(F.lit(0), last)).alias("run"))


def crawl_closure(
    seeds: DataFrame,
    edges: DataFrame,
    domains: DataFrame,
    rules: RuleLists | DataFrame,
    custom: DataFrame | None = None,
    settings: CrawlSettings = CrawlSettings(),
    max_rounds: int | None = None,
) -> DataFrame:
    """Every url the crawl reaches: url, round in which it was first reached, allowed.

    `edges` are EDGES rows (src, dst, pos).

    Seeds enter as they are. An allowed url is expanded: its links whose host is in the
    allow-list enter unless reached before. A url that robots rules stop is reached but not
    expanded. Ends when a round reaches nothing new, or after max_rounds.

    Links are filtered and bucketed by source page once, and each round appends its urls to a table
    bucketed by url, both in the shared work folder; what is rewritten or merged replaces what it was
    made of, and a run that breaks off leaves nothing. So a round shuffles only what it found, lineage
    stays short, and a lost executor costs only the running round. The driver sees one number per
    round. Shuffles and buckets follow the size of the tables (`_buckets`): while the crawl runs, the session's
    number of shuffle partitions is theirs."""
    spark = seeds.sparkSession
    folder = new_folder(spark, "closure")
    lists = rules if isinstance(rules, RuleLists) else rule_lists(rules, custom, keep=True)
    followed = restrict_links(edges, domains, settings.follow_links, settings.mode, url="dst").select("src", "dst", "pos")
    link_tables: list[str] = []
    reached: list[str] = []  # tables of reached urls; the last one has the last round

    def drop(table: str, files: bool = True) -> None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # external: the files stay
        if files:
            remove_folder(spark, f"{folder}/{table}")

    def read_files() -> DataFrame:
        """Read as plain files: the tables' buckets do not spare a merge its shuffle, if Spark reads them in splits."""
        return functools.reduce(DataFrame.unionByName, [spark.read.schema(REACHED).parquet(f"{folder}/{t}") for t in reached])

    def append_reached(rows: DataFrame, table: str) -> None:
        n = shuffle_partitions(spark)
        writer = rows.repartition(n, "url").write.mode("append").bucketBy(n, "url").sortBy("url")
        writer.option("path", f"{folder}/{table}").saveAsTable(table)
        if table not in reached:
            reached.append(table)

    def finish_round(urls: DataFrame, number: int) -> int:
        """Write a round's new urls with their verdicts; how many are to be expanded, counted as they pass."""
        checked = robots_allowed(urls, lists).select("url", "allowed", F.lit(number).alias("round"))
        counts = Observation()
        counted = checked.observe(counts, F.count_if("allowed").alias("n"))
        append_reached(counted, _table("reached") if number % MERGE_EVERY == 0 else reached[-1])
        return counts.get["n"]

    def merge() -> None:
        """One table, of one file per bucket, in place of those of the rounds so far."""
        old = list(reached)
        append_reached(read_files(), _table("reached"))
        for t in old:
            reached.remove(t)
            drop(t)

    number = 0
    try:
        with held(seeds.select("url").distinct(), "seeds") as start, held(followed, "followed") as rows:
            n = _buckets(spark, start, rows, *[t for t in (lists.sites, lists.index) if t is not None])
            with shuffled_in(spark, n):
                links, long_pages = _bucketed_edges(rows, folder, link_tables)
                more = finish_round(start, number)
        with shuffled_in(spark, n):
            while (max_rounds is None or number < max_rounds) and more:
                last = spark.table(reached[-1]).filter((F.col("round") == number) & F.col("allowed"))
                front = last.select(F.col("url").alias("src"))
                found = links.join(_runs(front, long_pages), ["src", "run"]).select(F.col("dst").alias("url")).distinct()
                for t in reached:
                    found = found.join(spark.table(t).select("url"), "url", "left_anti")
                number += 1
                more = finish_round(found, number)
                if more and number >= REWRITE_FROM and number & (number - 1) == 0:
                    for t in reached:
                        past = spark.table(t).filter(F.col("round") < number).select(F.col("url").alias("src"))
                        links = links.join(_runs(past, long_pages), ["src", "run"], "left_anti")
                    links = _write_bucketed(links, folder, link_tables)
                    drop(link_tables.pop(0))
                if more and number % MERGE_EVERY == MERGE_EVERY - 1:
                    merge()
        for table in reached:
            drop(table, files=False)
        return read_files().select("url", "round", "allowed")
    except BaseException:
        for table in reached:
            drop(table)
        raise
    finally:
        for table in link_tables:
            drop(table)


def _table(kind: str) -> str:
    return f"webframe_{kind}_{uuid.uuid4().hex}"
