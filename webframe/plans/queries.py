"""The registered queries: each operator on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.functions import html as H
from webframe.functions import url as U
from webframe.operators import content, control, frontier, links, log, redirects, robots, seen, slots, stats, steps, urls
from webframe.plans import tables as T
from webframe.plans.closure import crawl_closure
from webframe.plans.crawl import crawl_round, default_steps
from webframe.session import new_folder, written
from webframe.sources import docs, seeds
from webframe.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the queries; the SQL uses the same.
PURGED_HOST = "blog.tionsh.example.com"
PAGE_URL = r"^https?://[^/]*example\.(com|org)/"
SLOT_DELAY = 3600
MONTH_MINUTES = 30 * 24 * 60
ALL_HOURS = 24 * 60
# Text put before every link, and what it stands for.
REFERENCES = "a&#000000000038;b&#x000000026;c&#38d&#x26/e&apos;f&NotEqualTilde;/"
REFERRED = "a&b&c&d&/e'f\u2242\u0338/"


def _second(at: str = "crawl_time"):
    return (F.unix_seconds(at) - F.unix_seconds(F.lit(T.START).cast("timestamp"))).alias("crawl_second")


def _code():
    """The code, 0 without a response."""
    return F.coalesce("code", F.lit(0)).alias("code")


def _joined(c):
    return F.array_join(c, " ")


def _full_responses(spark, sf):
    return links.page_links(content.decode_content(T.responses(spark, sf)))


def _doc_rows(df: DataFrame) -> DataFrame:
    latin = F.col("headers")["content-type"].contains("ISO-8859-1")
    raw = F.when(latin, F.encode("body", "ISO-8859-1")).otherwise(F.encode("body", "UTF-8"))
    return df.select(
        "url", "domain", "code", "content_type", F.md5(raw).alias("body_md5"), _joined("links").alias("links"), _second()
    )


def to_docs(spark, sf):
    return _doc_rows(docs.to_docs(_full_responses(spark, sf)))


def read_docs(spark, sf):
    path = new_folder(spark, "docs")
    docs.write_docs(docs.to_docs(_full_responses(spark, sf)), path)
    return _doc_rows(docs.read_docs(spark, path))


def _version_rows(df: DataFrame) -> DataFrame:
    return df.select("url", "code", F.md5("body").alias("body_md5"), _second())


def append_first_wins(spark, sf):
    stored = T.versions(spark, sf, second=False).filter(T.is_https())
    new = T.versions(spark, sf, second=True).unionByName(T.versions(spark, sf, second=False))
    return _version_rows(docs.append_first_wins(stored, new))


def upsert_latest(spark, sf):
    new = T.versions(spark, sf, second=True).filter(T.is_https())
    return _version_rows(docs.upsert_latest(T.versions(spark, sf, second=False), new))


def need_fetch(spark, sf):
    stored = T.versions(spark, sf, second=False).filter(T.is_https())
    return docs.need_fetch(T.frontier(spark, sf), stored, enabled=True).select("url", "force")


def ingest_seeds(spark, sf):
    rows, _ = seeds.ingest_seeds(T.pages(spark, sf).select("url"))
    return rows.select("url", "host", "priority", "force")


def seed_domains(spark, sf):
    _, rows = seeds.ingest_seeds(T.pages(spark, sf).select("url"), strict_quirk=False)
    return rows.select("domain", "enabled")


def purge_host(spark, sf):
    return frontier.purge_host(T.frontier(spark, sf), PURGED_HOST).select("url", "host")


def with_url_parts(spark, sf):
    return urls.with_url_parts(T.pages(spark, sf).select("url"))


def resolve_urls(spark, sf):
    p = T.pages(spark, sf).withColumn("tags", H.link_tags(F.col("html")))
    hrefs = p.select(F.col("url").alias("base"), F.posexplode_outer(H.hrefs(F.col("tags"))).alias("pos", "href"))
    return urls.resolve_urls(hrefs.filter(F.col("href").isNotNull()))


def robots_urls(spark, sf):
    return urls.robots_urls(T.pages(spark, sf).select("url"))


def decode_content(spark, sf):
    d = content.decode_content(T.responses(spark, sf))
    latin = F.col("charset") == "ISO-8859-1"
    raw = F.when(latin, F.encode("content", "ISO-8859-1")).otherwise(F.encode("content", "UTF-8"))
    return d.select(
        "url",
        "content_type",
        "charset",
        F.coalesce(F.length("content"), F.lit(-1)).cast("bigint").alias("chars"),
        F.md5(raw).alias("content_md5"),
    )


def with_raw_len(spark, sf):
    return content.with_raw_len(T.responses(spark, sf)).select("url", "raw_len")


def extract_links(spark, sf):
    found = links.extract_links(T.pages(spark, sf))
    return found.select("url", F.size("links").cast("bigint").alias("n_links"), _joined("links").alias("links"))


def extract_links_entities(spark, sf):
    """All links, with character references of every kind built into them."""
    marked = T.pages(spark, sf).withColumn("html", F.replace("html", F.lit('href="/'), F.lit('href="/' + REFERENCES)))
    found = links.extract_links(marked)
    return found.select("url", F.size("links").cast("bigint").alias("n_links"), _joined("links").alias("links"))


def page_nofollow(spark, sf):
    """Pages with a robots meta in place of the charset meta, by the shape of their url."""
    listed = F.when(F.col("url").contains("?page="), "NoIndex,NoFollow").when(
        F.col("url").contains("#top"), "noindex, nofollow"
    )
    meta = F.concat(F.lit('<meta name="Robots" content="'), listed, F.lit('">'))
    plain = F.lit('<meta charset="utf-8">')
    marked = T.pages(spark, sf).withColumn("html", F.replace("html", plain, F.coalesce(meta, plain)))
    found = links.page_nofollow(links.extract_links(marked))
    return found.select("url", "nofollow", F.size("links").cast("bigint").alias("n_links"))


def redirect_links(spark, sf):
    return links.redirect_links(T.responses(spark, sf)).select("url", _code(), "redirect")


def page_links(spark, sf):
    return links.page_links(T.responses(spark, sf)).select("url", _joined("links").alias("links"))


def page_links_charsets(spark, sf):
    """Links of pages whose header names another charset than they declare and are written in."""
    latin = F.col("page_id") % 2 == 0
    html = F.when(latin, F.replace("html", F.lit('charset="utf-8"'), F.lit("charset=ISO-8859-1"))).otherwise(F.col("html"))
    body = F.when(latin, F.encode(html, "ISO-8859-1")).otherwise(F.encode(html, "UTF-8"))
    named = F.concat(F.lit("text/html; charset="), F.when(latin, "utf-8").otherwise("ISO-8859-1"))
    rows = T.pages(spark, sf).select(
        "url", F.lit(200).alias("code"), F.create_map(F.lit("content-type"), named).alias("headers"), body.alias("body")
    )
    return links.page_links(content.decode_content(rows)).select("url", _joined("links").alias("links"))


def link_edges(spark, sf):
    return T.link_rows(spark, sf)


def links_per_host(spark, sf):
    return T.link_rows(spark, sf).groupBy(U.host(F.col("dst")).alias("host")).agg(
        F.count("*").alias("links"), F.count_distinct("src").alias("pages"), F.count_distinct("dst").alias("targets")
    )


def map_pages(spark, sf):
    stored = T.pages(spark, sf).withColumnRenamed("html", "body")
    extract = links.css_extract("body", "article h1", "nav li a")
    found = links.map_pages(stored, PAGE_URL, extract, links.CSS_SCHEMA)
    return found.select("url", "name", _joined("urls").alias("urls"))


def _picky(url: str, body: str) -> dict | None:
    """A user job that fails on some pages and skips others."""
    if "?" in url:
        raise ValueError("query")
    return None if "#" in url else {"url": url, "chars": len(body)}


def map_pages_failed(spark, sf):
    """Rows of a user job and the pages on which it failed."""
    stored = T.pages(spark, sf).withColumnRenamed("html", "body")
    rows, failed = links.map_pages_failed(stored, PAGE_URL, _picky, "url string, chars long")
    return rows.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True).select("url", "chars", "error")


def resolve_redirects(spark, sf):
    return redirects.resolve_redirects(T.redirect_chains(spark, sf)).select("url", "target", "hops", "state")


def parse_robots(spark, sf):
    rules = robots.parse_robots(T.robots_txt(spark, sf))
    return rules.withColumn("agents", F.array_join("agents", ","))


def _ruleset(spark, sf):
    policy = robots.robots_status_policy(T.robots_txt(spark, sf), "pipeline")
    return robots.select_ruleset(robots.parse_robots(policy))


def select_ruleset(spark, sf):
    return _ruleset(spark, sf).select("robots_url", "group_no", "rule_no", "allow", "pattern")


def custom_ruleset(spark, sf):
    return robots.custom_ruleset(T.custom_rules(spark, sf))


def robots_allowed(spark, sf):
    rules = _ruleset(spark, sf)
    own = robots.custom_ruleset(T.custom_rules(spark, sf))
    return robots.robots_allowed(T.pages(spark, sf).select("url"), rules, own)


def robots_allowed_full(spark, sf):
    rules = _ruleset(spark, sf)
    own = robots.custom_ruleset(T.custom_rules(spark, sf))
    return robots.robots_allowed(T.pages(spark, sf).select("url"), rules, own, target="full")


def robots_wildcards(spark, sf):
    """All pages under operator rules of several wildcards made from the paths of each host's pages."""
    path = U.path(F.col("url"))
    made = F.concat(F.lit("/*"), F.substring(path, 2, 1), F.lit("*/*"), F.substring(path, -2, 1), F.lit("*"), F.right(path, F.lit(1)), F.lit("$"))
    own = T.pages(spark, sf).select(
        F.col("page_id").cast("string").alias("id"), U.host(F.col("url")).alias("site"), F.col("page_id").alias("ord"),
        (F.col("page_id") % 3 == 0).alias("flag"), made.alias("path"),
    )
    none = _ruleset(spark, sf).filter("false")
    return robots.robots_allowed(T.pages(spark, sf).select("url"), none, robots.custom_ruleset(own))


def robots_status_policy(spark, sf):
    t = T.robots_txt(spark, sf)
    strict = robots.robots_status_policy(t, "standalone").select("robots_url", F.col("content").alias("standalone"))
    return robots.robots_status_policy(t, "pipeline").select("robots_url", "code", "content").join(strict, "robots_url")


def robots_meta(spark, sf):
    return robots.robots_meta(T.robots_txt(spark, sf)).withColumn("agents", F.array_join("agents", ","))


def restrict_links(spark, sf):
    all_links = T.edges(spark, sf).select("src", F.col("dst").alias("url"))
    return frontier.restrict_links(all_links, T.domains(spark, sf)).groupBy("url").agg(F.count("*").alias("links"))


def frontier_add(spark, sf):
    queued = T.frontier(spark, sf).filter(T.is_https())
    return frontier.frontier_add(queued, T.seen(spark, sf), T.candidates(spark, sf)).select(
        "url", "host", "priority", "force"
    )


def frontier_add_filtered(spark, sf):
    queued = T.frontier(spark, sf).filter(T.is_https())
    done = T.seen(spark, sf)
    blocks = seen.blocks_for(T.pages(spark, sf).count())
    known = written(seen.seen_filter(done, blocks), "seen-filter")
    return seen.frontier_add_filtered(queued, done, T.candidates(spark, sf), known, blocks).select("url", "host", "priority", "force")


def _marked(spark, sf):
    done = T.pages(spark, sf).filter(F.col("url").contains("?")).select("url")
    return frontier.mark_done(T.frontier(spark, sf), T.seen(spark, sf), done)


def mark_done_frontier(spark, sf):
    return _marked(spark, sf)[0].select("url", "host")


def mark_done_seen(spark, sf):
    return _marked(spark, sf)[1]


def _queue(spark, sf):
    found = T.candidates(spark, sf).select("url").distinct()
    return found.select("url", U.host(F.col("url")).alias("host"), F.lit(1).alias("priority"))


def next_batch(spark, sf):
    return frontier.next_batch(_queue(spark, sf)).select("url", "host", "rn")


def fetch_plan(spark, sf):
    return frontier.fetch_plan(frontier.next_batch(_queue(spark, sf)), 2).select("url", "host", "wave")


def _slot_rows(df):
    return df.select("event_id", "host", F.unix_micros("start_at").alias("start_us"))


def polite_slots(spark, sf):
    return _slot_rows(slots.polite_slots(T.requests(spark, sf), SLOT_DELAY, tie=["event_id"])[0])


def polite_state(spark, sf):
    return slots.polite_slots(T.requests(spark, sf), SLOT_DELAY, tie=["event_id"])[1]


def queue_summary(spark, sf):
    queue, done = _marked(spark, sf)
    per_host = done.select(U.host(F.col("url")).alias("host"))
    r = T.responses(spark, sf).filter("code IS NOT NULL")
    times = r.select(F.concat(F.lit("response:"), U.host(F.col("url"))).alias("key"), F.col("request_time").alias("value"))
    return frontier.queue_summary(queue, per_host, stats.response_time_by_host(times))


def _closure(spark, sf):
    return crawl_closure(
        T.host_seeds(spark, sf),
        T.edges(spark, sf),
        T.domains(spark, sf),
        _ruleset(spark, sf),
        robots.custom_ruleset(T.custom_rules(spark, sf)),
    )


def replay_responses(spark, sf):
    archive = T.versions(spark, sf, second=False).unionByName(T.versions(spark, sf, second=True).filter(T.is_https()))
    batch = frontier.next_batch(_queue(spark, sf)).select("url", "rn")
    return docs.replay_responses(batch, archive).select(
        "url", "rn", _code(), F.md5("body").alias("body_md5")
    )


def _now(spark, sf):
    return T.traffic(spark, sf).select(F.max("crawl_time")).scalar()


def traffic_stats(spark, sf):
    return stats.traffic_stats(T.traffic(spark, sf), _now(spark, sf), MONTH_MINUTES)


def traffic_last_day(spark, sf):
    return stats.traffic_stats(T.traffic(spark, sf), _now(spark, sf), ALL_HOURS)


def step_metrics(spark, sf):
    return stats.step_metrics(T.metric_events(spark, sf))


def response_time_by_host(spark, sf):
    return stats.response_time_by_host(T.metric_events(spark, sf))


def crawl_log(spark, sf):
    return log.crawl_log(T.responses(spark, sf), "crawl_time").select("message")


def seed_log(spark, sf):
    return log.seed_log(T.pages(spark, sf).select("url")).select("message")


def log_tail(spark, sf):
    return log.log_tail(T.log(spark, sf))


def log_shown(spark, sf):
    return log.log_tail(T.log(spark, sf), shown=20)


def rules_listing(spark, sf):
    return control.rules_listing(T.custom_rules(spark, sf))


def apply_domain_changes(spark, sf):
    listed = T.domains(spark, sf).withColumn("domain", F.concat(F.lit("h"), (F.length("domain") % 60).cast("string")))
    changed = T.changes(spark, sf).withColumnRenamed("key", "domain")
    return control.apply_domain_changes(listed.dropDuplicates(["domain"]), changed).select("domain", "enabled")


def apply_rule_changes(spark, sf):
    c = T.changes(spark, sf)
    changed = c.select(
        "seq",
        "action",
        F.col("key").alias("id"),
        F.col("key").alias("site"),
        F.col("seq").alias("ord"),
        (F.col("event_type") == "view").alias("flag"),
        F.concat(F.lit("/"), "event_type").alias("path"),
    )
    return control.apply_rule_changes(T.custom_rules(spark, sf), changed)


def _lists(spark, sf):
    return robots.rule_lists(_ruleset(spark, sf), robots.custom_ruleset(T.custom_rules(spark, sf)))


def stop_counts(spark, sf):
    """The default steps over all pages: how many rows each step stops, and links of the others."""
    stored = T.versions(spark, sf, second=False).filter(T.is_https())
    chain = default_steps(stored, _lists(spark, sf), T.responses(spark, sf), need_fetch=True)
    done = steps.run_pipeline(T.frontier(spark, sf), chain)
    return done.groupBy(F.coalesce("stopped_by", F.lit("-")).alias("stopped_by")).agg(
        F.count("*").alias("rows"), F.sum(F.coalesce(F.size("links"), F.lit(0))).cast("bigint").alias("links")
    )


def pipeline_calls(spark, sf):
    """The default steps over all pages: how many rows each step treats."""
    stored = T.versions(spark, sf, second=False).filter(T.is_https())
    chain = default_steps(stored, _lists(spark, sf), T.responses(spark, sf), need_fetch=True)
    _, events = steps.run_pipeline(T.frontier(spark, sf), chain, timed=True)
    calls = F.regexp_extract("key", "^pipeline:(.*):calls$", 1)
    return events.select(calls.alias("step"), F.col("value").cast("bigint").alias("calls")).filter("step != ''")


def _round(spark, sf):
    return crawl_round(
        T.frontier(spark, sf), T.seen(spark, sf), T.versions(spark, sf, second=False), T.domains(spark, sf),
        _lists(spark, sf), T.responses(spark, sf),
    )


def crawl_round_log(spark, sf):
    return _round(spark, sf).log.select("message")


def crawl_round_frontier(spark, sf):
    return _round(spark, sf).frontier.select("url", "host")


def crawl_round_traffic(spark, sf):
    """Pages and bytes per second of a round's responses."""
    return stats.traffic_stats(_round(spark, sf).traffic, F.lit("2100-01-01").cast("timestamp"), minutes=60_000_000)


def _stream(spark, sf, name):
    """A table as a stream, be it one file or a folder of files: a stream's path may be a file only if it is a pattern."""
    return spark.readStream.schema(T.read(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def stream_new_links(spark, sf):
    folder = new_folder(spark, "new-links")
    T.link_rows(spark, sf).filter(F.col("src").contains("/en/")).select(F.col("dst").alias("url")).distinct().write.parquet(
        f"{folder}/seen"
    )
    found = links.link_edges(links.extract_links(_stream(spark, sf, "pages"))).select(F.col("dst").alias("url"))
    jobs.stream_new_links(found, f"{folder}/seen", f"{folder}/out", f"{folder}/checkpoint", available_now=True).awaitTermination()
    return spark.read.schema("url string").parquet(f"{folder}/out").select("url")


def stream_allowed(spark, sf):
    folder = new_folder(spark, "allowed")
    T.robots_txt(spark, sf).write.parquet(f"{folder}/robots")
    T.custom_rules(spark, sf).write.parquet(f"{folder}/rules")
    jobs.stream_allowed(
        _stream(spark, sf, "pages").select("url"), f"{folder}/robots", f"{folder}/rules", f"{folder}/out",
        f"{folder}/checkpoint", available_now=True,
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("url", "allowed")


def stream_traffic(spark, sf):
    folder = new_folder(spark, "traffic")
    rows = _stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("crawl_time"), F.floor("value").cast("bigint").alias("raw_len")
    )
    jobs.stream_traffic(rows, f"{folder}/out", f"{folder}/checkpoint", available_now=True).awaitTermination()
    return jobs.read_traffic(spark, f"{folder}/out")


def _streamed_metrics(spark, sf):
    folder = new_folder(spark, "metrics")
    rows = T.as_metrics(_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    jobs.stream_metrics(rows, f"{folder}/out", f"{folder}/checkpoint", available_now=True).awaitTermination()
    return f"{folder}/out"


def stream_step_metrics(spark, sf):
    return jobs.read_step_metrics(spark, _streamed_metrics(spark, sf))


def stream_response_times(spark, sf):
    return jobs.read_response_times(spark, _streamed_metrics(spark, sf))


def stream_polite_slots(spark, sf):
    folder = new_folder(spark, "slots")
    rows = T.as_requests(_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    jobs.stream_polite_slots(
        rows, SLOT_DELAY, f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint", ["event_id"], available_now=True
    ).awaitTermination()
    return _slot_rows(spark.read.parquet(f"{folder}/out"))


def stream_store(spark, sf):
    folder = new_folder(spark, "store")
    found = links.page_links(content.decode_content(T.as_responses(_stream(spark, sf, "pages"))))
    jobs.stream_store(docs.to_docs(found), f"{folder}/docs", f"{folder}/checkpoint", available_now=True).awaitTermination()
    return _doc_rows(docs.read_docs(spark, f"{folder}/docs"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        read_docs, to_docs, append_first_wins, upsert_latest, need_fetch, ingest_seeds, seed_domains, purge_host,
        with_url_parts, resolve_urls, robots_urls, decode_content, with_raw_len,
        extract_links, extract_links_entities, page_nofollow, redirect_links, page_links, page_links_charsets, link_edges, links_per_host, map_pages, map_pages_failed, resolve_redirects,
        parse_robots, select_ruleset, custom_ruleset, robots_allowed, robots_allowed_full, robots_wildcards, robots_status_policy,
        robots_meta, restrict_links, frontier_add, frontier_add_filtered, mark_done_frontier, mark_done_seen, next_batch, fetch_plan,
        polite_slots, polite_state, queue_summary, replay_responses,
        traffic_stats, traffic_last_day, step_metrics, response_time_by_host, crawl_log, seed_log, log_tail, log_shown,
        rules_listing, apply_domain_changes, apply_rule_changes, stop_counts, pipeline_calls, crawl_round_log, crawl_round_frontier, crawl_round_traffic,
        stream_new_links, stream_allowed, stream_traffic, stream_step_metrics, stream_response_times, stream_polite_slots, stream_store,
    )
}
QUERIES["crawl_closure"] = _closure
