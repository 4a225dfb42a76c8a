"""One round of the crawl over tables, and the default steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.operators.content import decode_content, with_raw_len
from webframe.operators.frontier import fetch_plan, frontier_add, mark_done, next_batch, restrict_links
from webframe.operators.links import page_links
from webframe.operators.log import crawl_log
from webframe.operators.robots import RuleLists, robots_allowed
from webframe.operators.steps import Step, run_pipeline
from webframe.session import checkpointed
from webframe.settings import CrawlSettings
from webframe.sources.docs import replay_responses, to_docs


def need_fetch_step(docs: DataFrame, enabled: bool = False) -> Step:
    """Stops urls that are stored already, unless forced. Off by default."""

    def process(df: DataFrame) -> DataFrame:
        if not enabled:
            return df
        stored = docs.select(F.col("url").alias("_stored")).distinct()
        again = F.col("_stored").isNotNull() & ~F.coalesce(F.col("force"), F.lit(False))
        return df.join(stored, F.col("url") == F.col("_stored"), "left").withColumn("stop", again).drop("_stored")

    return Step("NeedFetch", process, needed=True)


def robots_step(rules: RuleLists) -> Step:
    """Stops urls that robots rules disallow."""

    def process(df: DataFrame) -> DataFrame:
        return robots_allowed(df, rules).withColumn("stop", ~F.col("allowed")).drop("allowed")

    return Step("RobotCheck", process, needed=True)


def fetch_step(archive: DataFrame) -> Step:
    """Attaches the archived response and its decoded content."""
    return Step("Fetch", lambda df: decode_content(replay_responses(df, archive)), needed=True)


def links_step() -> Step:
    """Attaches redirect and page links."""
    return Step("LinkExtraction", page_links, needed=True)


def default_steps(
    docs: DataFrame, rules: RuleLists, archive: DataFrame, need_fetch: bool = False
) -> list[Step]:
    return [need_fetch_step(docs, need_fetch), robots_step(rules), fetch_step(archive), links_step()]


MakeSteps = Callable[[DataFrame, RuleLists, DataFrame, bool], list[Step]]


def process_batch(
    batch: DataFrame,
    docs: DataFrame,
    rules: RuleLists,
    archive: DataFrame,
    need_fetch: bool = False,
    make_steps: MakeSteps = default_steps,
) -> DataFrame:
    """The batch's urls after the steps (by default the default ones), stopped ones included.

    Checkpointed after robots rules have stopped rows (urls only), so that the archive is joined
    once, and at the end, as several results are made of it."""
    return checkpointed(run_pipeline(batch, make_steps(docs, rules, archive, need_fetch)))


def timed_batch(
    batch: DataFrame, docs: DataFrame, rules: RuleLists, archive: DataFrame, need_fetch: bool, make_steps: MakeSteps
) -> tuple[DataFrame, DataFrame]:
    """process_batch with the METRIC_EVENTS of its steps; every step is checkpointed."""
    return run_pipeline(batch, make_steps(docs, rules, archive, need_fetch), timed=True)


def fetched(results: DataFrame) -> DataFrame:
    """Responses of a processed batch as traffic rows: crawl_time, raw_len. Every response counts."""
    return with_raw_len(results.filter("stopped_by IS NULL AND code IS NOT NULL")).select("crawl_time", "raw_len")


def found_links(results: DataFrame, domains: DataFrame, settings: CrawlSettings) -> DataFrame:
    """Links of processed pages that may be queued."""
    each = results.filter("stopped_by IS NULL").select(F.explode("links").alias("url"), F.lit(False).alias("force"))
    return restrict_links(each, domains, settings.follow_links, settings.mode)


def result_log(results: DataFrame) -> DataFrame:
    """Log rows of a processed batch; a stopped url was not crawled."""
    return crawl_log(results.withColumn("code", F.when(F.col("stopped_by").isNull(), F.col("code"))))


@dataclass(frozen=True)
class Round:
    """What a round gives: processed urls, pages to store, new frontier and seen set, log and traffic rows."""

    results: DataFrame
    docs: DataFrame
    frontier: DataFrame
    seen: DataFrame
    log: DataFrame
    traffic: DataFrame


def crawl_round(
    frontier: DataFrame,
    seen: DataFrame,
    docs: DataFrame,
    domains: DataFrame,
    rules: RuleLists,
    archive: DataFrame,
    settings: CrawlSettings = CrawlSettings(),
    make_steps: MakeSteps = default_steps,
) -> Round:
    """Take a batch per host, run the steps, follow links, and move what was processed to seen."""
    batch = fetch_plan(next_batch(frontier, settings.host_batch), settings.domain_concurrency)
    results = process_batch(batch, docs, rules, archive, settings.need_fetch, make_steps)
    left, done = mark_done(frontier, seen, results)
    return Round(
        results=results,
        docs=to_docs(results.filter("stopped_by IS NULL")),
        frontier=frontier_add(left, done, found_links(results, domains, settings)),
        seen=done,
        log=result_log(results),
        traffic=fetched(results),
    )
