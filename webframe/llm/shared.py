"""Helpers of the operators: tables in the shared folder, worker-local caches, row ids."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.session import new_folder, remove_folder, shuffle_partitions

__all__ = ["Steps", "blocks_of", "let", "new_folder", "shuffle_partitions", "small_batches", "spent_shuffles", "stored", "worker_state"]

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row however often body uses it."""
    return F.transform(F.array(value), body)[0]


@contextmanager
def spent_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within the block, shuffle files go as soon as the query that made them has ended.

    Jobs of several written steps would else hold the shuffles of all of them on disk."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before or "false")


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Python workers are given about `size` bytes at once, one row at least, by queries that run within the block.

    For rows of megabytes: a batch of Spark's usual size is held several times over by the JVM and by the worker."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with spent_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """Tables that an operator writes on its way. `drop` removes one that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def stored(self, df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
        """group_rows: rows of a row group, of which Spark holds up to 4096 rows at once when it reads; few for rows of megabytes."""
        path = new_folder(self.spark, name)
        with spent_shuffles(self.spark):
            write = df.write.option("compression", "zstd")
            (write.option("parquet.block.row.count.limit", group_rows) if group_rows else write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        remove_folder(self.spark, self.paths.pop(id(df)))


def worker_state(owner: str) -> types.ModuleType:
    """A module that lives as long as the Python worker, for caches that outlast a task.

    Functions of this package reach workers by value, so their own globals are new in every task. A worker serves one
    operator after the other, and holds the caches of one only: what it has of another goes when `owner` changes."""
    name = "_webframe_worker_state"
    if name not in sys.modules or sys.modules[name].owner != owner:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].owner = owner
    return sys.modules[name]


def blocks_of(batches, text: str, limit: int):
    """Arrow batches cut into runs of rows of about `limit` bytes of text, one row at least."""
    for batch in batches:
        sizes = batch.column(text).nbytes / max(1, batch.num_rows)
        step = max(1, int(limit / max(1.0, sizes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
