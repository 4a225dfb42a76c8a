"""Running values over groups of any size.

A window per key puts all rows of a key in one task. Here rows are range-partitioned by key
and order, so a large key spreads over many blocks; values run within each block, and what
earlier blocks of the same key add is carried in by a join. Only a block's first key can have
begun in an earlier block, so the carried table never has more rows than there are blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webframe.session import shuffle_partitions


def in_blocks(df: DataFrame, key: str, order: list[str], blocks: int | None = None) -> DataFrame:
    """Add _block. For each key, blocks follow `order`, which must settle all ties."""
    n = blocks or shuffle_partitions(df.sparkSession)
    return df.repartitionByRange(n, key, *order).withColumn("_block", F.spark_partition_id())


def block_window(key: str, order: list[str]):
    return Window.partitionBy(key, "_block").orderBy(*order)


def earlier_blocks(key: str):
    return Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
