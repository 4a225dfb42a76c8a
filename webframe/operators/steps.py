"""User-ordered steps over a table of urls."""

from __future__ import annotations

import importlib
import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webframe import schemas
from webframe.session import written

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Step:
    """A named DataFrame -> DataFrame function.

    It may add a boolean column `stop` (true: the row skips later steps) and a boolean column
    `failed` (true: the row goes on as it was before the step). A `needed` step is never left out."""

    name: str
    process: Callable[[DataFrame], DataFrame]
    needed: bool = False


def _as_step(item: Step | str | Callable[[DataFrame], DataFrame]) -> Step:
    if isinstance(item, Step):
        return item
    if isinstance(item, str):
        module, _, name = item.rpartition(".")
        return _as_step(getattr(importlib.import_module(module), name))
    return Step(item.__name__, item)


def row_step(name: str, function: Callable[[Row], dict | None], columns: str) -> Step:
    """A step of user code: `function(row)` gives the row's new `columns` (DDL; `stop` may be one).

    A row on which it raises, or for which it gives None, is marked `failed` and goes on as it was; others
    are not touched by that. Batches go to Python by Arrow."""
    made = T._parse_datatype_string(columns)
    names = made.fieldNames()

    def one(row):
        try:
            got = function(row)
            if got is not None:
                return (False, *[got.get(n) for n in names])
        except Exception:
            log.exception("step %s failed on a row", name)
        return (True, *[None] * len(names))

    def process(df: DataFrame) -> DataFrame:
        result = T.StructType([T.StructField("failed", T.BooleanType()), *made.fields])
        rows = [c for c in df.columns if c != "_before"]
        out = df.withColumn("_made", F.udf(one, result, useArrow=True)(F.struct(*[F.col(f"`{c}`") for c in rows])))
        return out.withColumns({n: F.col(f"_made.{n}") for n in ["failed", *names]}).drop("_made")

    return Step(name, process)


def run_pipeline(
    df: DataFrame,
    steps: Sequence[Step | str | Callable[[DataFrame], DataFrame]],
    timed: bool = False,
    keep_gates: bool = True,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Run steps in order. All rows are returned, stopped ones with the step's name in `stopped_by`.

    A failure is never taken for a result. Rows on which a step's own code fails are marked `failed` by it (see
    row_step) and go on unchanged; one bad row never takes the step from others. A step that raises while it is
    planned is logged and left out, unless it is `needed`: then the error is raised. `failed_steps` names the steps
    that a row has missed in either way. What fails while Spark runs is raised, whatever the step: it is no row's failure.
    Rows that are stopped leave the flow at once, so later steps never see them; the stopped rows and the
    others are two readers of the steps up to there, and `keep_gates` writes the rows to the shared folder at
    such steps, so that the work is done once and later steps know how few rows are left. Steps fuse into
    Spark stages; to measure each one, `timed` writes after every step, where its rows are counted as they
    pass, and returns METRIC_EVENTS rows (pipeline:<step>:calls and :time) as well."""
    spark = df.sparkSession
    active = df.withColumns({"stopped_by": F.lit(None).cast("string"), "failed_steps": F.array().cast("array<string>")})
    missed: list[str] = []
    finished: list[DataFrame] = []
    events: list[tuple[str, float]] = []
    for step in map(_as_step, steps):
        before = active.columns
        began = time.time()
        try:
            out = step.process(active.withColumn("_before", F.struct(*before)))
            if "failed" in out.columns:
                failed = F.coalesce(F.col("failed"), F.lit(False))
                columns = {c: F.when(failed, F.col("_before")[c]).otherwise(F.col(c)) for c in before}
                columns["failed_steps"] = F.when(failed, F.array_append("_before.failed_steps", F.lit(step.name))).otherwise(F.col("failed_steps"))
                if "stop" in out.columns:
                    columns["stop"] = ~failed & F.col("stop")
                out = out.withColumns(columns).drop("failed")
            out = out.drop("_before")
            if "failed_steps" not in out.columns:  # a step may choose its columns
                out = out.withColumn("failed_steps", F.array(*map(F.lit, missed)).cast("array<string>"))
        except Exception:
            log.exception("step %s failed", step.name)
            if step.needed:
                raise
            missed.append(step.name)
            active = active.withColumn("failed_steps", F.array_append("failed_steps", F.lit(step.name)))
            continue
        if timed:
            rows = Observation()
            out = written(out.observe(rows, F.count(F.lit(1)).alias("calls")), "step")
            events.append((f"pipeline:{step.name}:time", time.time() - began))
            events.append((f"pipeline:{step.name}:calls", float(rows.get["calls"])))
        elif keep_gates and "stop" in out.columns:
            out = written(out, "step")
        if "stop" in out.columns:
            stop = F.coalesce(F.col("stop"), F.lit(False))
            finished.append(out.filter(stop).drop("stop").withColumn("stopped_by", F.lit(step.name)))
            out = out.filter(~stop).drop("stop")
        active = out
    result = active
    for part in finished:
        result = result.unionByName(part, allowMissingColumns=True)
    if not timed:
        return result
    now = F.current_timestamp().alias("ts")
    metrics = spark.createDataFrame(events, "key string, value double").select("key", "value", now)
    return result, metrics.to(spark.createDataFrame([], schemas.METRIC_EVENTS).schema)
