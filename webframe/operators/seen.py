"""A Bloom filter of the urls seen, of native bitmaps.

The filter is a table of blocks of BITS bits. A url belongs to one block, by a hash, and sets HASHES of its bits; so filters are
built by one partial aggregation, merge by OR in any order, and a url meets one block of it. A filter takes about ten bits a url
where the seen set takes the whole url. A url that it does not know is new for certain. Of those that it knows about one in a hundred
is new too, so these are looked up in the seen set: results are exact, whatever the filter holds, as long as no seen
url is missing from it. The number of blocks is fixed for a filter's life (`blocks_for` the urls expected); an overfull filter is
slower, not wrong."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.operators.frontier import candidate_urls, queue_rows
from webframe.sources.keyed import MergedTable

#: The bits of Spark's bitmap aggregates.
BITS = 32768
HASHES = 7
BITS_PER_URL = 10
BLOCKS = "block long, bits binary"


def blocks_for(urls: int) -> int:
    """The number of blocks for so many urls."""
    return max(1, -(-urls * BITS_PER_URL // BITS))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("block")), F.lit(blocks))


def _places(url: Column) -> list[Column]:
    first, step = F.xxhash64(url), F.xxhash64(url, F.lit("step")).bitwiseOR(F.lit(1))
    return [F.pmod(F.pmod(first, F.lit(BITS)) + i * F.pmod(step, F.lit(BITS)), F.lit(BITS)) for i in range(HASHES)]


def seen_filter(seen: DataFrame, blocks: int) -> DataFrame:
    """The filter of the urls of `seen` (repeated ones and nulls do no harm): BLOCKS rows."""
    url = F.col("url")
    bits = seen.select(_block(url, blocks).alias("block"), F.explode(F.array(*_places(url))).alias("place"))
    return bits.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))


def merged_filter(filters: DataFrame) -> DataFrame:
    """One filter of the rows of many that have the same number of blocks."""
    return filters.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def _bit(bits: Column, place: Column) -> Column:
    byte = F.substring(bits, F.floor(place / 8).cast("int") + 1, 1)
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int")) == 1


def probed(urls: DataFrame, known: DataFrame, blocks: int, name: str = "maybe_seen") -> DataFrame:
    """urls with a further column: false where a url is new for certain."""
    held = known.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    met = urls.join(held, _block(F.col("url"), blocks) == F.col("_block"), "left")
    every = F.col("_bits").isNotNull()
    for place in _places(F.col("url")):
        every = every & _bit(F.col("_bits"), place)
    return met.withColumn(name, F.coalesce(every, F.lit(False))).drop("_block", "_bits")


def frontier_add_filtered(
    frontier: DataFrame,
    seen: DataFrame | Callable[[DataFrame], DataFrame],
    candidates: DataFrame,
    known: DataFrame,
    blocks: int,
    keep_force: bool = False,
) -> DataFrame:
    """As `frontier_add`, but only candidates that the filter `known` may hold are looked up in the seen set.

    `seen` may be a function of these candidates (a url column), so that a keyed table opens their buckets alone."""
    marked = probed(candidate_urls(candidates), known, blocks, "_maybe")
    asked = F.col("_maybe") & ~F.col("force")
    maybe = marked.filter(asked)
    done = seen(maybe.select("url")) if callable(seen) else seen
    fresh = marked.filter(~asked).unionByName(maybe.join(done.select("url"), "url", "left_anti")).drop("_maybe")
    return frontier.unionByName(queue_rows(fresh.join(frontier.select("url"), "url", "left_anti"), keep_force))


class FilterTable(MergedTable):
    """A filter kept in runs that are merged by doubling; batches add the urls they have seen."""

    def __init__(self, spark: SparkSession, path: str, blocks: int):
        super().__init__(spark, path, BLOCKS, ["block"], {"bits": "bitmap_or_agg"})
        self.blocks = blocks

    def add(self, seen: DataFrame, number: int) -> None:
        self.append(seen_filter(seen, self.blocks), number)
