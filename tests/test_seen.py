"""The seen filter: exact results, merging, and how many urls skip the look-up."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from webframe import schemas
from webframe.operators import seen as S
from webframe.operators.frontier import frontier_add
from webframe.sources.keyed import KeyedTable

AT = datetime(2024, 1, 1)


def urls(spark, low, high):
    return spark.range(low, high).select(F.format_string("http://h%d/p/%d", F.col("id") % 7, "id").alias("url"))


@pytest.fixture(scope="module")
def parts(spark):
    blocks = S.blocks_for(20_000)
    return blocks, [S.seen_filter(urls(spark, 5_000 * i, 5_000 * (i + 1)), blocks) for i in range(4)]


def test_no_seen_url_is_missed_and_few_others_are_asked(spark, parts):
    blocks, filters = parts
    assert blocks == 7
    known = S.merged_filter(filters[0].union(filters[1]).union(filters[2]).union(filters[3]).union(filters[3]))
    assert known.count() == blocks
    marked = S.probed(urls(spark, 0, 60_000), known, blocks)
    old = (F.regexp_extract("url", r"(\d+)$", 1).cast("int") < 20_000).alias("old")
    counts = marked.groupBy(old).agg(F.count("*").alias("n"), F.count_if("maybe_seen").alias("maybe"))
    found = {r.old: (r.n, r.maybe) for r in counts.collect()}
    assert found[True] == (20_000, 20_000)
    assert found[False][0] == 40_000 and found[False][1] < 0.03 * 40_000


def test_merged_filters_equal_one_filter(spark, parts):
    blocks, filters = parts
    whole = S.seen_filter(urls(spark, 0, 10_000), blocks)
    both = S.merged_filter(filters[1].union(filters[0]))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, both.collect()))


@pytest.mark.parametrize("blocks", [1, 5])
@pytest.mark.parametrize("filled", [0, 30, 3_000])
def test_as_frontier_add(spark, blocks, filled):
    """Same rows whatever the filter: empty, sparse or overfull; forced, repeated and queued candidates, and null urls."""
    done = urls(spark, 0, filled)
    frontier = urls(spark, 40, 60).select("url", F.lit("h").alias("host"), F.lit(1).alias("priority"), F.lit(False).alias("force"), F.lit(AT).alias("added_at"))
    some = urls(spark, 0, 100).withColumn("force", F.col("url").endswith("7"))
    some = some.unionByName(some.withColumn("force", F.lit(None).cast("boolean"))).unionByName(spark.createDataFrame([(None, False)], "url string, force boolean"))
    some = some.withColumn("added_at", F.lit(AT))
    got = S.frontier_add_filtered(frontier, done, some, S.seen_filter(done, blocks), blocks, keep_force=True)
    want = frontier_add(frontier, done, some, keep_force=True)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_filter_table_opens_only_the_buckets_of_what_it_may_hold(spark, tmp_path):
    done = KeyedTable(spark, str(tmp_path / "seen"), schemas.SEEN, buckets=64)
    known = S.FilterTable(spark, str(tmp_path / "filter"), S.blocks_for(8_000))
    for i in range(8):
        batch = urls(spark, 1_000 * i, 1_000 * (i + 1))
        done.append(batch, i)
        known.add(batch, i)
        known.add(batch, i)  # again
    assert len(known.runs()) <= 4
    asked = []

    def looked_up(maybe):
        asked.append(maybe)
        return done.keys(maybe)

    new = urls(spark, 100_000, 100_500).unionByName(urls(spark, 17, 19)).withColumns({"force": F.lit(False), "added_at": F.lit(AT)})
    nothing = spark.createDataFrame([], schemas.FRONTIER)
    got = S.frontier_add_filtered(nothing, looked_up, new, known.read(), known.blocks)
    assert got.count() == 500
    assert asked[0].count() < 2 + 0.05 * 500
