"""A crawl kept in a folder: seeds in, rounds over an archive, pages and reports out.

Tables of the folder:

    queue          urls to fetch (frontier rows), by url: seeds and found links come, processed urls go
    seen           processed urls and the number of their round, by url
    stored         urls of the page store, by url
    slot_state     until when each host is taken, by host
    log, metrics   LOG and METRIC_EVENTS rows (steps' calls and times, hosts' response times)
    traffic        responses: crawl_time, raw_len
    slots          when each url of a round may be fetched (wave, start_at)
    docs           the page store; with the latest-wins store all versions
    domains        allow-list
    custom_rules   operator's robots rules (may be missing)

All but the last three are tables of numbered runs (`sources.keyed`), merged as they add up. Every change, seeds or a round, has a number and
writes its rows under it, that of `seen` last: a change without it did not happen, and is made again under the same number.
A round reads the queue, which holds open urls only, and of the other tables the buckets of the urls at hand; no table of all
urls ever is grouped or read through."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe import schemas
from webframe.functions import url as U
from webframe.operators import robots
from webframe.operators.content import decode_content
from webframe.operators.control import apply_domain_changes
from webframe.operators.frontier import fetch_plan, frontier_add, next_batch, queue_summary
from webframe.operators.log import seed_log
from webframe.operators.slots import polite_slots
from webframe.operators.stats import response_time_by_host, step_metrics, traffic_stats
from webframe.operators.urls import robots_urls
from webframe.plans.crawl import MakeSteps, default_steps, fetched, found_links, result_log, timed_batch
from webframe.session import checkpointed, held
from webframe.settings import TRAFFIC_MINUTES, CrawlSettings
from webframe.sources.docs import append_first_wins, latest_versions, read_docs, replay_responses, stored_urls, to_docs, write_docs
from webframe.sources.keyed import BUCKETS, KeyedTable, RunTable
from webframe.sources.seeds import ingest_seeds

SLOT_STATE = "host string, free_us long"
#: Tables of rows that every round adds to.
REPORTS = {
    "log": schemas.LOG,
    "metrics": schemas.METRIC_EVENTS,
    "traffic": "crawl_time timestamp, raw_len long",
    "slots": "url string, host string, wave int, start_at timestamp",
}


class Crawl:
    """A crawl in `folder`. `make_steps(docs, rules, archive, need_fetch)` gives the steps of a round.

    `buckets` is the number of buckets of url-keyed tables, fixed when the crawl begins."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        settings: CrawlSettings = CrawlSettings(),
        make_steps: MakeSteps = default_steps,
        buckets: int = BUCKETS,
    ):
        self.spark, self.folder, self.settings, self.make_steps = spark, folder, settings, make_steps
        if settings.store not in ("first", "latest"):
            raise ValueError(f"unknown store {settings.store!r}")
        self.queue = KeyedTable(spark, f"{folder}/queue", schemas.FRONTIER, buckets=buckets)
        self.done = KeyedTable(spark, f"{folder}/seen", schemas.SEEN + ", round int", buckets=buckets)
        self.stored = KeyedTable(spark, f"{folder}/stored", schemas.SEEN, buckets=buckets)
        self.hosts = KeyedTable(spark, f"{folder}/slot_state", SLOT_STATE, "host", buckets)
        self.reports = {n: RunTable(spark, f"{folder}/{n}", s) for n, s in REPORTS.items()}

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        """A table of the folder as it is now; empty while it does not exist."""
        if name in self.reports:
            return self.reports[name].read()
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def next_number(self) -> int:
        last = self.done.last()
        return 0 if last is None else last + 1

    def seen(self) -> DataFrame:
        return self.done.read()

    def queued(self) -> DataFrame:
        """The frontier: urls to fetch. A change that broke off does not count."""
        return self.queue.read(upto=self.next_number() - 1)

    def add_seeds(self, urls: DataFrame, strict_quirk: bool = True) -> None:
        """Queue seeds (a url column), allow their hosts, and log them."""
        number = self.next_number()
        rows, hosts = ingest_seeds(urls, strict_quirk)
        changes = hosts.select(F.lit(1).alias("seq"), F.lit("add").alias("action"), "domain")
        known = self.table("domains", schemas.DOMAINS)
        new = checkpointed(apply_domain_changes(known, changes).join(known.select("domain"), "domain", "left_anti"))
        new.write.mode("append").parquet(f"{self.folder}/domains")
        self.queue.append(rows, number)
        self.reports["log"].append(seed_log(rows), number)
        self.done.append(self.spark.createDataFrame([], schemas.SEEN + ", round int"), number)

    def _rules(self, batch: DataFrame, archive: DataFrame) -> tuple[robots.RuleLists, DataFrame]:
        """Rules for a batch from the archived robots.txt files, and these files as pages to store.

        The operator's rules are read again, so that changes count from the next round on."""
        wanted = robots_urls(batch).select(F.col("robots_url").alias("url"), "host")
        files = checkpointed(decode_content(replay_responses(wanted, archive)))
        texts = files.select(F.col("url").alias("robots_url"), "host", "code", "content")
        parsed = robots.parse_robots(robots.robots_status_policy(texts, "pipeline"))
        own = robots.custom_ruleset(self.table("custom_rules", schemas.CUSTOM_RULES))
        lists = robots.rule_lists(robots.select_ruleset(parsed, self.settings.robot_name), own, keep=True)
        return lists, to_docs(files.withColumn("links", F.array().cast("array<string>")))

    def docs(self) -> DataFrame:
        """The page store: one row per url."""
        rows = read_docs(self.spark, f"{self.folder}/docs") if self.stored.last() is not None else self.spark.createDataFrame([], schemas.DOCS)
        return latest_versions(rows) if self.settings.store == "latest" else rows

    def _store(self, pages: DataFrame, number: int) -> None:
        """Write pages under the change's number, then their urls."""
        with held(pages, "pages") as new:
            if self.settings.store == "first":
                new = append_first_wins(self.stored.keys(new, upto=number - 1), new)
            write_docs(new, f"{self.folder}/docs", "overwrite", number)
        self.stored.append(stored_urls(self.spark, f"{self.folder}/docs", number), number)

    def _plan(self, batch: DataFrame, number: int) -> None:
        """Write in which wave, and how soon, each url may be fetched without crowding its host."""
        state = self.hosts.read(batch, upto=number - 1).join(batch.select("host").distinct(), "host", "left_semi")
        at = batch.select("url", "host", "rn", F.lit(self.now()).alias("at"))
        slots, after = polite_slots(fetch_plan(at, self.settings.domain_concurrency), self.settings.crawl_delay, tie=["rn"], state=state)
        self.reports["slots"].append(slots.select("url", "host", "wave", "start_at"), number)
        with held(after, "slot-state") as rows:
            self.hosts.append(rows, number)

    @staticmethod
    def now() -> datetime:
        return datetime.now(UTC).replace(tzinfo=None)

    def run_round(self, archive: DataFrame) -> bool:
        """Process one batch of every host; False when nothing was queued."""
        number, settings = self.next_number(), self.settings
        with held(next_batch(self.queued(), settings.host_batch), "batch") as batch:
            if batch.isEmpty():
                return False
            self._plan(batch, number)
            rules, robots_pages = self._rules(batch, archive)
            known = self.stored.keys(batch, upto=number - 1)
            results, events = timed_batch(batch, known, rules, archive, settings.need_fetch, self.make_steps)

            self._store(to_docs(results.filter("stopped_by IS NULL")).unionByName(robots_pages), number)
            timed = results.filter("stopped_by IS NULL AND request_time IS NOT NULL")
            key = F.concat(F.lit("response:"), F.col("host"))
            now = F.current_timestamp().alias("ts")
            hosts = timed.select(key.alias("key"), F.col("request_time").alias("value"), now)
            self.reports["metrics"].append(hosts.unionByName(events), number)
            self.reports["traffic"].append(fetched(results), number)
            self.reports["log"].append(result_log(results), number)
            links = found_links(results, self.table("domains", schemas.DOMAINS), settings).select("url").distinct()
            with held(links.withColumn("force", F.lit(False)), "found") as found:
                past = number - 1
                known = self.done.keys(found, upto=past).union(batch.select("url"))
                # links to urls that are open already bring nothing new; of these only the buckets of the links are read
                queued = self.queue.read(found, upto=past)
                added = frontier_add(queued, known, found).join(queued.select("url"), "url", "left_anti")
                with held(added, "added") as new:
                    self.queue.append(new, number, gone=batch)
            # last, as it closes the round
            self.done.append(batch.select("url", F.lit(number).alias("round")), number)
        return True

    def run(self, archive: DataFrame, rounds: int | None = None) -> int:
        """Run rounds until nothing is queued, or so many; how many were run."""
        done = 0
        while (rounds is None or done < rounds) and self.settings.crawler_running and self.run_round(archive):
            done += 1
        return done

    def traffic(self, now: datetime, minutes: int = TRAFFIC_MINUTES) -> DataFrame:
        """Pages and bytes per second in each of the last minutes."""
        return traffic_stats(self.table("traffic"), now, minutes)

    def steps(self) -> DataFrame:
        """Calls and times of each step over all rounds."""
        return step_metrics(self.table("metrics"))

    def summary(self) -> DataFrame:
        """Queue, crawled urls and mean response time per host."""
        crawled = self.done.keys().select(U.host(F.col("url")).alias("host"))
        times = response_time_by_host(self.table("metrics"))
        return queue_summary(self.queued(), crawled, times)
