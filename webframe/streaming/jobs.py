"""Streaming jobs. Each returns a started query; paths lie in a folder all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from webframe import schemas
from webframe.operators.robots import (
    custom_ruleset,
    parse_robots,
    robots_allowed,
    robots_status_policy,
    select_ruleset,
)
from webframe.operators.slots import polite_slots
from webframe.operators.stats import (
    RESPONSE_SUMS,
    STEP_COUNTS,
    pages_per_second,
    response_means,
    response_sums,
    step_counts,
    step_summary,
)
from webframe.session import held, remove_folder
from webframe.settings import ROBOT_NAME, TRAFFIC_BUCKET_SECONDS
from webframe.sources.docs import append_first_wins, stored_urls, write_docs
from webframe.sources.keyed import BUCKETS, KeyedTable, MergedTable, RunTable


def _start(writer: DataStreamWriter, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that the job itself writes, and that may not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _given(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """A table that others write: empty if the caller has none, an error if it is not where the caller says."""
    return spark.createDataFrame([], schema) if path is None else spark.read.schema(schema).parquet(path)


EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


class _Found(StatefulProcessor):
    """Gives a url when it is found and not remembered; remembers it for `ttl_ms` from then on."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.remembered = handle.getValueState("remembered", "is boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        if not self.remembered.exists():
            self.remembered.update((True,))
            yield pd.DataFrame({"url": [key[0]]})

    def close(self) -> None:
        pass


def stream_new_links(
    links: DataFrame,
    seen_path: str | None,
    out_path: str,
    checkpoint: str,
    available_now: bool = False,
    ttl: timedelta | None = None,
) -> StreamingQuery:
    """Write each discovered url once, unless it is in SEEN when it is first found.

    The urls found so far are the query's state, and no output is read again: a batch costs what it holds. With the RocksDB state
    store the state lies on disk. Without `ttl` none is ever forgotten. With it a url is remembered for that long (of processing
    time) after it was given, so the state is bounded by what is found in that time; one that is found again later is
    given again, unless it has been processed by then and SEEN holds it. `ttl` needs the RocksDB state store. SEEN is
    read again for every batch. A batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        seen = _given(batch.sparkSession, seen_path, schemas.SEEN)
        batch.join(seen, "url", "left_anti").write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    if ttl is None:
        new = links.select("url").dropDuplicates(["url"])
    else:
        found = _Found(round(ttl.total_seconds() * 1000))
        by_url = links.select("url").filter("url IS NOT NULL").groupBy("url")
        new = by_url.transformWithStateInPandas(found, schemas.SEEN, "Update", "ProcessingTime")
        spark = links.sparkSession
        # what has expired is removed with the next links; batches only for that would go on without end
        empty_batches = spark.conf.get(EMPTY_BATCHES)
        spark.conf.set(EMPTY_BATCHES, "false")
        try:
            return _start(new.writeStream.outputMode("update").foreachBatch(write), checkpoint, available_now)
        finally:
            spark.conf.set(EMPTY_BATCHES, empty_batches)
    return _start(new.writeStream.foreachBatch(write), checkpoint, available_now)


def stream_allowed(
    urls: DataFrame,
    robots_path: str,
    rules_path: str | None,
    out_path: str,
    checkpoint: str,
    robot_name: str = ROBOT_NAME,
    available_now: bool = False,
) -> StreamingQuery:
    """Write each url with its robots verdict. Every batch reads ROBOTS_TXT and CUSTOM_RULES again,
    so that edited rules count from the next batch on. `rules_path` is None where the operator has no rules."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        texts = robots_status_policy(_given(spark, robots_path, schemas.ROBOTS_TXT))
        own = custom_ruleset(_given(spark, rules_path, schemas.CUSTOM_RULES))
        rules = select_ruleset(parse_robots(texts), robot_name)
        robots_allowed(batch, rules, own).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return _start(urls.writeStream.foreachBatch(write), checkpoint, available_now)


TRAFFIC_SUMS = "bucket_ms long, pages long, bytes long"


def _traffic(spark: SparkSession, path: str) -> MergedTable:
    return MergedTable(spark, path, TRAFFIC_SUMS, ["bucket_ms"])


def _first(checkpoint: str, *tables: RunTable) -> int:
    """The number in these tables of batch 0 of a checkpoint; makes tables that are not there yet."""
    for t in tables:
        t.create()
    lasts = [n for n in (t.last() for t in tables) if n is not None]
    return _first_number(tables[0].spark, checkpoint, max(lasts, default=-1) + 1)


def stream_traffic(
    responses: DataFrame, out_path: str, checkpoint: str, at: str = "crawl_time", available_now: bool = False
) -> StreamingQuery:
    """Add each batch's pages and bytes per minute to a table that `read_traffic` reads.

    No response is late: a minute is shown from its first response on and grows with whatever comes. The sums of n
    batches lie in about log2(n) runs, and one that is run again replaces its own."""
    b = TRAFFIC_BUCKET_SECONDS
    table = _traffic(responses.sparkSession, out_path)
    first = _first(checkpoint, table)

    def write(batch: DataFrame, number: int) -> None:
        minute = (F.floor(F.unix_seconds(at) / b) * b * 1000).cast("long").alias("bucket_ms")
        sums = batch.groupBy(minute).agg(F.count("*").alias("pages"), F.sum("raw_len").cast("long").alias("bytes"))
        table.append(sums, first + number)

    return _start(responses.writeStream.foreachBatch(write), checkpoint, available_now)


def read_traffic(spark: SparkSession, out_path: str) -> DataFrame:
    """Pages and bytes per second of each minute so far. A folder that no job has made is an error."""
    return _traffic(spark, out_path).opened().read().select(
        "bucket_ms",
        pages_per_second(F.col("pages")).alias("pages_per_s"),
        F.expr(f"bytes div {TRAFFIC_BUCKET_SECONDS}").alias("bytes_per_s"),
    )


def _metrics(spark: SparkSession, path: str) -> tuple[MergedTable, MergedTable]:
    steps = MergedTable(spark, f"{path}/steps", STEP_COUNTS, ["step", "kind", "ms"])
    return steps, MergedTable(spark, f"{path}/hosts", RESPONSE_SUMS, ["host"])


def stream_metrics(metric_events: DataFrame, out_path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Add each batch's METRIC_EVENTS to histograms per step and sums per host, which `read_step_metrics` and
    `read_response_times` turn into the same figures as the batch operators give over all events so far.

    The histograms keep every millisecond that occurs, so the median is exact; their size does not grow with the events.
    A batch that is run again replaces what it added."""
    tables = _metrics(metric_events.sparkSession, out_path)
    first = _first(checkpoint, *tables)

    def write(batch: DataFrame, number: int) -> None:
        with held(batch, "metrics") as events:
            for table, rows in zip(tables, (step_counts(events), response_sums(events))):
                table.append(rows, first + number)

    return _start(metric_events.writeStream.foreachBatch(write), checkpoint, available_now)


def read_step_metrics(spark: SparkSession, out_path: str) -> DataFrame:
    return step_summary(_metrics(spark, out_path)[0].opened().read())


def read_response_times(spark: SparkSession, out_path: str) -> DataFrame:
    return response_means(_metrics(spark, out_path)[1].opened().read())


SLOT_STATE = "host string, free_us long"


def stream_polite_slots(
    requests: DataFrame,
    delay: float,
    out_path: str,
    state_path: str,
    checkpoint: str,
    tie: list[str],
    available_now: bool = False,
) -> StreamingQuery:
    """Write each request (host, at, tie columns) with its start_at, per-host state kept across batches.

    A batch reads the state that the batch before it wrote and writes its own version, so a batch that is
    run again gives the same rows; a state that is not there is an error, for politeness would start anew.
    Versions that no batch can ask for any more are removed. Within a batch the work of one large host is
    spread over many tasks, which a function called once per host could not do."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{state_path}/batch={number - 1}"
        state = _given(spark, before if number > 0 else None, SLOT_STATE)
        slots, new_state = polite_slots(batch, delay, tie=tie, state=state)
        slots.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        new_state.write.mode("overwrite").parquet(f"{state_path}/batch={number}")
        remove_folder(spark, f"{state_path}/batch={number - 2}")

    return _start(requests.writeStream.foreachBatch(write), checkpoint, available_now)


def _first_number(spark: SparkSession, checkpoint: str, next_number: int) -> int:
    """The number that batch 0 of a checkpoint has in a table which other queries may have written to before.

    Noted beside the checkpoint when the query starts for the first time."""
    note = f"{checkpoint.rstrip('/')}-first"
    noted = _written(spark, note, "number int").first()
    if noted is not None:
        return noted["number"]
    spark.createDataFrame([(next_number,)], "number int").coalesce(1).write.mode("overwrite").parquet(note)
    return next_number


def stream_store(
    docs: DataFrame, path: str, checkpoint: str, available_now: bool = False, index_path: str | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """Append pages whose url is not stored yet.

    An index of the store's urls (`index_path`, by default beside the store) answers that: a batch opens the buckets of its own urls and
    no others, and reads no page. It writes its pages under its number, then its urls under the same; a batch that is run again
    sees the index as it was before and replaces what it wrote. A store without an index is indexed once, at the start."""
    spark = docs.sparkSession
    index = KeyedTable(spark, index_path or f"{path.rstrip('/')}-urls", schemas.SEEN, buckets=buckets)
    if index.last() is None:
        index.append(_written(spark, path, schemas.SEEN).select("url").distinct(), 0)
    first = _first_number(spark, checkpoint, index.last() + 1)

    def write(batch: DataFrame, number: int) -> None:
        at = first + number
        with held(batch, "pages") as pages:
            new = append_first_wins(index.keys(pages, upto=at - 1), pages)
            write_docs(new, path, "overwrite", at)
        index.append(stored_urls(spark, path, at), at)

    return _start(docs.writeStream.foreachBatch(write), checkpoint, available_now)
