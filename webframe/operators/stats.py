"""Traffic, step and host statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webframe.settings import TRAFFIC_BUCKET_SECONDS, TRAFFIC_MINUTES


def pages_per_second(count: Column) -> Column:
    """To one decimal, half up, in whole numbers."""
    b = TRAFFIC_BUCKET_SECONDS
    return F.floor((count * 10 + b // 2) / b) / 10


def traffic_stats(
    responses: DataFrame, now: datetime | Column, minutes: int = TRAFFIC_MINUTES, at: str = "crawl_time"
) -> DataFrame:
    """Pages and bytes per second in each minute of the last `minutes` and the current one.

    Minutes without responses are left out. The time range is a filter on the scan."""
    b = TRAFFIC_BUCKET_SECONDS
    end = F.unix_seconds(F.lit(now) if not isinstance(now, Column) else now)
    bucket_now = end - F.pmod(end, F.lit(b))
    in_range = (F.col(at) >= F.timestamp_seconds(bucket_now - minutes * b)) & (
        F.col(at) < F.timestamp_seconds(bucket_now + b)
    )
    second = F.unix_seconds(at)
    per_bucket = (
        responses.filter(in_range)
        .groupBy((second - F.pmod(second, F.lit(b))).alias("_start"))
        .agg(F.count("*").alias("_pages"), F.sum(F.col("raw_len").cast("bigint")).alias("_bytes"))
    )
    return per_bucket.select(
        (F.col("_start") * 1000).alias("bucket_ms"),
        pages_per_second(F.col("_pages")).alias("pages_per_s"),
        F.expr(f"_bytes div {b}").alias("bytes_per_s"),
    )


def _micros(value: Column) -> Column:
    """Seconds as whole microseconds, so that sums do not depend on their order."""
    return F.round(value * 1_000_000).cast("bigint")


STEP_COUNTS = "step string, kind string, ms long, n long, us long, value double"
RESPONSE_SUMS = "host string, us long, n long"


def step_counts(metric_events: DataFrame) -> DataFrame:
    """Histograms of keys pipeline:<step>:<kind>, one row per step, kind and millisecond: STEP_COUNTS rows.

    Those of two tables merge by adding up n, us and value per step, kind and ms."""
    parts = F.split("key", ":")
    events = (
        metric_events.filter(F.col("key").startswith("pipeline:") & (F.size(parts) == 3))
        .select(F.get(parts, 1).alias("step"), F.get(parts, 2).alias("kind"), "value")
        .filter(F.col("kind").isin("calls", "time"))
    )
    is_time = F.col("kind") == "time"
    ms = F.when(is_time, (F.col("value") * 1000).cast("bigint"))
    return events.groupBy("step", "kind", ms.alias("ms")).agg(
        F.count("*").alias("n"),
        F.sum(_micros(F.col("value"))).alias("us"),
        F.sum("value").alias("value"),
    )


def step_summary(counted: DataFrame) -> DataFrame:
    """Calls, and upper median and mean time in whole ms, of histograms with one row per step, kind and millisecond.

    Cutting to whole milliseconds keeps order, so the median of the counted values is the median's cut value."""
    is_time = F.col("kind") == "time"
    per_kind = Window.partitionBy("step", "kind")
    up_to = per_kind.orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns({"upto": F.sum("n").over(up_to), "all": F.sum("n").over(per_kind)})
    middle = is_time & (F.col("upto") > F.expr("`all` div 2"))
    per_step = ranked.groupBy("step").agg(
        F.sum(F.when(~is_time, F.col("value"))).cast("bigint").alias("calls"),
        F.min(F.when(middle, F.col("ms"))).alias("median"),
        F.sum(F.when(is_time, F.col("us")).cast("decimal(38,0)")).alias("us"),
        F.sum(F.when(is_time, F.col("n"))).alias("n"),
    )
    return per_step.select("step", "calls", "median", F.expr("us div (n * 1000)").alias("ave"))


def step_metrics(metric_events: DataFrame) -> DataFrame:
    """Per step of keys pipeline:<step>:<kind>: calls, and upper median and mean time in whole ms.

    Times are counted per step and millisecond before they are shuffled."""
    return step_summary(step_counts(metric_events))


def response_sums(metric_events: DataFrame) -> DataFrame:
    """Sums of keys response:<host>, RESPONSE_SUMS rows; those of two tables merge by adding up per host."""
    return (
        metric_events.filter(F.col("key").startswith("response:"))
        .groupBy(F.regexp_replace("key", "^response:", "").alias("host"))
        .agg(F.sum(_micros(F.col("value"))).alias("us"), F.count("value").alias("n"))
    )


def response_means(sums: DataFrame) -> DataFrame:
    """Mean to two decimals, of one row per host."""
    return sums.select("host", (F.expr("(us + 5000 * n) div (10000 * n)") / 100).alias("ave_resp"))


def response_time_by_host(metric_events: DataFrame) -> DataFrame:
    """Mean of keys response:<host>, to two decimals."""
    return response_means(response_sums(metric_events))
