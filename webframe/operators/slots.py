"""Earliest start of each request so that requests to a host keep their distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webframe.operators.blocks import block_window, earlier_blocks, in_blocks
from webframe.session import checkpointed
from webframe.settings import CrawlSettings

MICROS = 1_000_000


def _numbered(requests: DataFrame, delay_us: int, host: str, at: str, tie: list[str], blocks: int | None) -> DataFrame:
    """Each request with its number _k in its block and the running maximum of the earlier
    requests of the block (_before) and up to itself (_upto)."""
    order = [at, *tie]
    w = block_window(host, order)
    t = F.unix_micros(at)
    numbered = in_blocks(requests, host, order, blocks).withColumn("_k", F.row_number().over(w).cast("bigint"))
    lead = t - (F.col("_k") - 1) * F.lit(delay_us).cast("bigint")
    return numbered.withColumns(
        {
            "_before": F.max(lead).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "_upto": F.max(lead).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )


def polite_slots(
    requests: DataFrame,
    delay: float = CrawlSettings().crawl_delay,
    host: str = "host",
    at: str = "at",
    tie: list[str] | None = None,
    state: DataFrame | None = None,
    blocks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Requests with start_at, and the new state (host, free_us) of each host.

    A host's state is the time until which it is taken. A request at t finds state v: if v > t
    it starts at v + delay and that is the new state; else it starts at t and the new state is
    t + delay. Either way the new state is max(v, t) + delay, so before the k-th request it is
        (k - 1) * delay + max(v0, max of t_j - (j - 1) * delay for j < k),
    a running maximum. `tie` names columns that order requests of one instant; with `at` they
    must be unique per host. The numbered requests are checkpointed, since both the carried
    values and the result read them."""
    delay_us = round(delay * MICROS)
    step = F.lit(delay_us).cast("bigint")
    local = checkpointed(_numbered(requests, delay_us, host, at, tie or [], blocks))

    # per host and block: rows, and the block's maximum
    totals = local.groupBy(host, "_block").agg(F.count("*").alias("_n"), F.max("_upto").alias("_max"))
    back = earlier_blocks(host)
    offset = totals.withColumn("_offset", F.coalesce(F.sum("_n").over(back), F.lit(0)))
    shifted = offset.withColumn("_max", F.col("_max") - F.col("_offset") * step)
    carried = shifted.withColumn("_carry", F.max("_max").over(back))
    # at most one row per block, see blocks.py
    carry = F.broadcast(carried.filter("_offset > 0").select(host, "_block", "_offset", "_carry"))

    rows = local.join(carry, [host, "_block"], "left").withColumn("_offset", F.coalesce("_offset", F.lit(0)))
    ended = carried.groupBy(host).agg(F.sum("_n").alias("_n"), F.max("_max").alias("_max"))
    if state is None:
        rows = rows.withColumn("_v0", F.lit(None).cast("bigint"))
        new_state = ended.withColumn("_v0", F.lit(None).cast("bigint"))
    else:
        first = state.select(host, F.col("free_us").alias("_v0"))
        rows = rows.join(first, host, "left")
        new_state = ended.join(first, host, "full")
    new_state = new_state.select(
        host,
        F.when(F.col("_n").isNull(), F.col("_v0"))
        .otherwise(F.col("_n") * step + F.greatest("_max", "_v0"))
        .alias("free_us"),
    )

    t = F.unix_micros(at)
    earlier = F.greatest(F.col("_before") - F.col("_offset") * step, F.col("_carry"), F.col("_v0"))
    taken = (F.col("_offset") + F.col("_k") - 1) * step + earlier
    start = F.when(taken > t, taken + step).otherwise(t)
    return rows.select(*requests.columns, F.timestamp_micros(start).alias("start_at")), new_state
