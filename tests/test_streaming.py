import pathlib
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from webframe import schemas
from webframe.operators.slots import polite_slots
from webframe.operators.stats import response_time_by_host, step_metrics, traffic_stats
from webframe.plans.queries import QUERIES
from webframe.sources.docs import read_docs
from webframe.streaming import jobs

START = datetime(2024, 1, 1)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def stream(spark, tmp_path):
    """A stream of the given batches, one file each; more can be added later."""
    count = iter(range(100))

    def add(schema, *batches):
        for rows in batches:
            n = next(count)
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"f={n:02}"))

    def open_(schema, *batches):
        add(schema, *batches)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        return source.parquet(str(tmp_path / "in" / "*"))

    open_.add = add
    open_.path = lambda name: str(tmp_path / name)
    return open_


def finish(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def forget_last_commit(checkpoint):
    """As if the job had broken off after writing its last batch: the batch will be run again."""
    commits = pathlib.Path(checkpoint, "commits")
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    (commits / str(last)).unlink()
    (commits / f".{last}.crc").unlink(missing_ok=True)


LINKS = "url string, found_at timestamp"


def urls_in(spark, path):
    return sorted(r.url for r in spark.read.schema("url string").parquet(path).collect())


def test_new_links(spark, stream):
    spark.createDataFrame([("seen",)], schemas.SEEN).write.parquet(stream.path("seen"))
    hour = timedelta(hours=1)
    batches = [
        [("a", START + 9 * hour), ("a", START), ("seen", START)],
        [("a", START), ("b", START - 5 * hour)],  # late ones count like any others
        [("a", START + 99 * hour), ("c", START + 99 * hour), ("seen", START + 99 * hour)],
    ]
    args = (stream.path("seen"), stream.path("out"), stream.path("ckpt"))
    finish(jobs.stream_new_links(stream(LINKS, *batches), *args, available_now=True))
    assert urls_in(spark, stream.path("out")) == ["a", "b", "c"]
    stream.add(LINKS, [("c", START + 9 * hour), ("d", START + 9 * hour)])
    finish(jobs.stream_new_links(stream(LINKS), *args, available_now=True))
    assert urls_in(spark, stream.path("out")) == ["a", "b", "c", "d"]


@pytest.fixture
def rocks(spark):
    """State that can expire is kept in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_new_links_with_a_long_memory_equal_the_batch(spark, stream, rocks):
    spark.createDataFrame([("u1",), ("u2",)], schemas.SEEN).write.parquet(stream.path("seen"))
    rng = random.Random(6)
    batches = [[(f"u{rng.randrange(40)}", START) for _ in range(30)] for _ in range(3)]
    args = (stream.path("seen"), stream.path("out"), stream.path("ckpt"))
    finish(jobs.stream_new_links(stream(LINKS, *batches), *args, available_now=True, ttl=timedelta(days=1)))
    assert urls_in(spark, stream.path("out")) == sorted({u for b in batches for u, _ in b} - {"u1", "u2"})


def test_forgotten_links_fall_back_to_the_seen_ones(spark, stream, rocks):
    """After its time a url is given again unless it has been processed; what is remembered does not add up."""
    spark.createDataFrame([], schemas.SEEN).write.parquet(stream.path("seen"))
    args = (stream.path("seen"), stream.path("out"), stream.path("ckpt"))
    kw = {"available_now": True, "ttl": timedelta(seconds=4)}
    remembered = []
    for n, (urls, want) in enumerate((("a b s a", "a b s"), ("a s c d", "a b s a c d"), ("e", "a b s a c d e"))):
        stream.add(LINKS, [(u, START) for u in urls.split()])
        query = finish(jobs.stream_new_links(stream(LINKS), *args, **kw))
        remembered.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        assert urls_in(spark, stream.path("out")) == sorted(want.split())
        if n == 0:
            spark.createDataFrame([("s",)], schemas.SEEN).write.mode("append").parquet(stream.path("seen"))
        time.sleep(5)
    assert remembered[-1] <= remembered[0] + 4


def test_no_earlier_output_is_read(spark, stream):
    """What was written can be moved away: the state alone tells which urls were found."""
    args = (None, stream.path("out"), stream.path("ckpt"))
    finish(jobs.stream_new_links(stream(LINKS, [("a", START)]), *args, available_now=True))
    pathlib.Path(stream.path("out")).rename(stream.path("moved"))
    stream.add(LINKS, [("a", START), ("b", START)])
    finish(jobs.stream_new_links(stream(LINKS), *args, available_now=True))
    assert urls_in(spark, stream.path("out")) == ["b"]


def test_given_tables_must_exist(spark, stream):
    links = stream(LINKS, [("a", START)])
    with pytest.raises(StreamingQueryException):
        jobs.stream_new_links(links, stream.path("none"), stream.path("o"), stream.path("c1"), available_now=True).awaitTermination()
    with pytest.raises(StreamingQueryException):
        args = (stream.path("none"), None, stream.path("o"), stream.path("c2"))
        jobs.stream_allowed(links.select("url"), *args, available_now=True).awaitTermination()


def test_edited_rules_count_from_the_next_batch(spark, stream):
    text = "User-agent: *\nDisallow: /a"
    spark.createDataFrame([("http://h/robots.txt", "h", 200, text)], schemas.ROBOTS_TXT).write.parquet(stream.path("txt"))
    batch = [("http://h/a",), ("http://h/b",), ("http://h/c",)]

    def run(rules):
        args = (stream.path("txt"), rules, stream.path("out"), stream.path("ckpt"))
        finish(jobs.stream_allowed(stream("url string", batch), *args, available_now=True))

    run(None)
    spark.createDataFrame([("1", "h", 1, False, "/b")], schemas.CUSTOM_RULES).write.parquet(stream.path("rules"))
    run(stream.path("rules"))
    got = spark.read.parquet(stream.path("out")).orderBy("batch", "url").collect()
    assert [r.allowed for r in got] == [False, True, True, False, False, True]


def test_traffic_as_batch(spark, stream):
    """Rows in any order over the batches, the last minute included."""
    rng = random.Random(1)
    rows = sorted((START + timedelta(seconds=rng.randrange(3600)), rng.randrange(1000)) for _ in range(500))
    last = rows[-1][0]
    mixed = rng.sample(rows, len(rows))
    schema = "crawl_time timestamp, raw_len long"
    source = stream(schema, mixed[:200], mixed[200:350], mixed[350:])
    for _ in range(2):
        finish(jobs.stream_traffic(source, stream.path("out"), stream.path("ckpt"), available_now=True))
        got = jobs.read_traffic(spark, stream.path("out"))
        want = traffic_stats(spark.createDataFrame(rows, schema), last, 120)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        forget_last_commit(stream.path("ckpt"))
    with pytest.raises(FileNotFoundError):
        jobs.read_traffic(spark, stream.path("mistyped"))


def test_traffic_of_many_batches_in_few_runs(spark, stream):
    """A second checkpoint adds to the table; sums of 13 batches lie in few runs."""
    schema = "crawl_time timestamp, raw_len long"
    rows = [(START + timedelta(seconds=50 * i), i) for i in range(12)]
    finish(jobs.stream_traffic(stream(schema, *[[r] for r in rows]), stream.path("out"), stream.path("ckpt"), available_now=True))
    again = spark.readStream.schema(schema).parquet(stream.path("in/*"))
    finish(jobs.stream_traffic(again, stream.path("out"), stream.path("other"), available_now=True))
    want = traffic_stats(spark.createDataFrame(rows + rows, schema), rows[-1][0], 120)
    assert sorted(map(tuple, jobs.read_traffic(spark, stream.path("out")).collect())) == sorted(map(tuple, want.collect()))
    assert len(list(pathlib.Path(stream.path("out")).iterdir())) <= 5


def test_metrics_as_batch(spark, stream):
    """Histograms of batches merge to the exact median; a batch that is run again counts once."""
    rng = random.Random(4)
    keys = ["pipeline:a:time", "pipeline:a:calls", "pipeline:b:time", "pipeline:b:calls", "response:h", "response:g:80", "other", "pipeline:x"]
    rows = [(rng.choice(keys), float(rng.randrange(1, 9)) if i % 2 else rng.random(), START) for i in range(400)]
    rows = [(k, float(round(v)) if k.endswith("calls") else v, t) for k, v, t in rows] + [("response:h", None, START)]
    schema = "key string, value double, ts timestamp"
    source = stream(schema, rows[:150], rows[150:151], [], rows[151:300], rows[300:])
    events = spark.createDataFrame(rows, schema)
    for _ in range(2):
        finish(jobs.stream_metrics(source, stream.path("out"), stream.path("ckpt"), available_now=True))
        for got, want in (
            (jobs.read_step_metrics(spark, stream.path("out")), step_metrics(events)),
            (jobs.read_response_times(spark, stream.path("out")), response_time_by_host(events)),
        ):
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        forget_last_commit(stream.path("ckpt"))


def test_slots_keep_two_versions_of_their_state(spark, stream):
    schema = "at timestamp, i int, host string"
    source = stream(schema, *[[(START + timedelta(seconds=i), i, "h")] for i in range(5)])
    args = (stream.path("out"), stream.path("state"), stream.path("ckpt"), ["i"])
    finish(jobs.stream_polite_slots(source, 1.0, *args, available_now=True))
    left = pathlib.Path(stream.path("state"))
    assert sorted(f.name for f in left.iterdir()) == ["batch=3", "batch=4"]
    (left / "batch=4").rename(stream.path("lost"))
    stream.add(schema, [(START + timedelta(seconds=9), 9, "h")])
    with pytest.raises(StreamingQueryException):
        jobs.stream_polite_slots(stream(schema), 1.0, *args, available_now=True).awaitTermination()


def test_slots_as_batch(spark, stream):
    rng = random.Random(2)
    rows = sorted((START + timedelta(seconds=rng.randrange(300)), i, rng.choice("hhhhhab")) for i in range(400))
    schema = "at timestamp, i int, host string"
    cuts = [rows[:100], rows[100:101], rows[101:300], rows[300:]]
    finish(
        jobs.stream_polite_slots(
            stream(schema, *cuts), 1.0, stream.path("out"), stream.path("state"), stream.path("ckpt"), ["i"], available_now=True
        )
    )
    want, state = polite_slots(spark.createDataFrame(rows, schema), 1.0, tie=["i"])
    got = spark.read.parquet(stream.path("out")).select("at", "i", "host", "start_at")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    last = spark.read.parquet(stream.path("state/batch=3"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, state.collect()))


def test_batches_may_run_again(spark, stream):
    rows = [(START + timedelta(seconds=i // 9), i, "h", f"u{i % 70}") for i in range(200)]
    schema = "at timestamp, i int, host string, url string"
    source = stream(schema, rows[:90], rows[90:])
    links, slots, state = (stream.path(n) for n in ("links", "slots", "state"))

    def run():
        finish(jobs.stream_new_links(source, None, links, stream.path("c1"), available_now=True))
        finish(jobs.stream_polite_slots(source, 1.0, slots, state, stream.path("c2"), ["i"], available_now=True))
        pages = source.select("url", F.col("host").alias("domain"), F.lit(200).alias("code"), F.lit("b").alias("body"),
                              F.col("at").alias("crawl_time"))
        finish(jobs.stream_store(pages, stream.path("docs"), stream.path("c3"), available_now=True))
        out = spark.read.schema("url string").parquet(links), spark.read.parquet(slots), spark.read.parquet(state)
        return [sorted(map(tuple, df.collect())) for df in (*out, read_docs(spark, stream.path("docs")).select("url", "code"))]

    first = run()
    assert [len(rows) for rows in first] == [70, 200, 2, 70]
    for checkpoint in ("c1", "c2", "c3"):
        forget_last_commit(stream.path(checkpoint))
    assert run() == first


def test_store_keeps_the_first_version(spark, stream):
    def doc(url, body, second):
        return (url, "h", 200, body, [], {}, "text/html", START + timedelta(seconds=second))

    batches = [[doc("a", "a0", 0), doc("a", "a1", 1)], [doc("a", "a2", 2), doc("b", "b2", 2)], [doc("b", "b0", 0)]]
    finish(
        jobs.stream_store(stream(schemas.DOCS, *batches), stream.path("docs"), stream.path("ckpt"), available_now=True)
    )
    assert sorted((r.url, r.body) for r in read_docs(spark, stream.path("docs")).collect()) == [("a", "a0"), ("b", "b2")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The tables with pages in a folder of files, as large tables lie."""
    sf = tmp_path_factory.mktemp("tables")
    spark.read.parquet(f"{SMALL}/pages.parquet").repartition(3).write.parquet(str(sf / "pages.parquet"))
    (sf / "events.parquet").symlink_to(f"{SMALL}/events.parquet")
    return str(sf)


def of_files_and_folders(spark, folders, name):
    return [sorted(map(tuple, QUERIES[name](spark, sf).collect()), key=repr) for sf in (SMALL, folders)]


def test_allowed_of_a_table_of_many_files(spark, folders):
    one, many = of_files_and_folders(spark, folders, "stream_allowed")
    assert len(one) == 50 and one == many


def test_new_links_of_a_table_of_many_files(spark, folders):
    one, many = of_files_and_folders(spark, folders, "stream_new_links")
    assert one and one == many


def test_store_of_a_table_of_many_files(spark, folders):
    one, many = of_files_and_folders(spark, folders, "stream_store")
    assert one and one == many
