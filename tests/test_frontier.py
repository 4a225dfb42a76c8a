import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from webframe import schemas
from webframe.operators import frontier as Q
from webframe.operators.slots import polite_slots
from webframe.sources.docs import need_fetch
from webframe.sources.seeds import ingest_seeds

AT = datetime(2024, 1, 1)


def queue(frame, *urls, force=False):
    return frame([(u, u.split("/")[2], 1, force, AT) for u in urls], schemas.FRONTIER)


def urls(df):
    return sorted(r.url for r in df.select("url").collect())


def one(frame, *values, schema="url string"):
    return frame([(v,) for v in values], schema)


def test_restrict(frame):
    links = one(frame, "http://a.b.com/", "http://b.com/x", "http://B.com/", "http://b.com:80/")
    allow = frame([("b.com", False, None)], schemas.DOMAINS)
    none = frame([], schemas.DOMAINS)
    assert urls(Q.restrict_links(links, allow)) == ["http://b.com/x", "http://b.com:80/"]
    assert urls(Q.restrict_links(links, none)) == []
    assert len(urls(Q.restrict_links(links, none, mode="internet"))) == 4
    assert len(urls(Q.restrict_links(links, allow, mode="internet"))) == 2
    assert urls(Q.restrict_links(links, allow, follow_links=False)) == []
    with pytest.raises(ValueError):
        Q.restrict_links(links, allow, mode="x")


def test_add(frame):
    f = queue(frame, "http://h/queued")
    seen = one(frame, "http://h/seen", "http://h/forced")
    new = frame(
        [("http://h/seen", False), ("http://h/forced", True), ("http://h/forced", False), ("http://h/new", False),
         ("http://h/new", None), ("http://h/queued", True)], "url string, force boolean",
    )
    once = Q.frontier_add(f, seen, new)
    assert urls(once) == ["http://h/forced", "http://h/new", "http://h/queued"]
    assert {r.force for r in once.collect()} == {False}
    assert urls(Q.frontier_add(once, seen, new)) == urls(once)
    kept = Q.frontier_add(f, seen, new, keep_force=True)
    assert [r.url for r in kept.filter("force").collect()] == ["http://h/forced"]


def test_done_keeps_queue_and_seen_apart(frame):
    f = queue(frame, *[f"http://h/{i}" for i in range(10)])
    done = one(frame, "http://h/1", "http://h/1", "http://h/5", "http://h/other")
    left, seen = Q.mark_done(f, one(frame, "http://h/5", "http://h/old"), done)
    assert len(urls(left)) == 8
    assert urls(seen) == ["http://h/1", "http://h/5", "http://h/old", "http://h/other"]
    assert not set(urls(left)) & set(urls(seen))


@pytest.mark.parametrize("threshold", ["1000", "3"])
def test_batch_and_plan(frame, spark, threshold):
    names = [f"http://h/{i:02}" for i in range(25)]
    f = queue(frame, *names, "http://k/é", "http://k/z")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
    try:
        batch = Q.next_batch(f)
        assert [r.url for r in batch.filter("host = 'h'").orderBy("rn").collect()] == names[:4:-1]
        assert [r.url for r in batch.filter("host = 'k'").orderBy("rn").collect()] == ["http://k/é", "http://k/z"]
        waves = [(r.wave, r.host) for r in Q.fetch_plan(Q.next_batch(f, 5), 2).select("wave", "host").collect()]
        assert waves == [(0, "h"), (0, "h"), (0, "k"), (0, "k"), (1, "h"), (1, "h"), (2, "h")]
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_batch_takes_few_rows_per_task_before_the_shuffle(frame):
    plan = Q.next_batch(queue(frame, "http://h/1"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_summary(frame):
    f = queue(frame, "http://www.b.com/1", "http://a.com/1", "http://a.com/2")
    done = one(frame, "c.com", "a.com", schema="host string")
    times = frame([("a.com", 0.25), ("x.com", 1.0)], "host string, ave_resp double")
    assert [tuple(r) for r in Q.queue_summary(f, done, times).collect()] == [
        ("a.com", 2, 1, 0.25), ("www.b.com", 1, 0, 0.0), ("c.com", 0, 1, 0.0),
    ]


def test_purge(frame):
    assert urls(Q.purge_host(queue(frame, "http://h/1", "http://k/1"), "h")) == ["http://k/1"]


def test_need_fetch(frame):
    f = queue(frame, "http://h/1", "http://h/2").unionByName(queue(frame, "http://h/3", force=True))
    stored = one(frame, "http://h/1", "http://h/3")
    assert len(urls(need_fetch(f, stored))) == 3
    assert urls(need_fetch(f, stored, enabled=True)) == ["http://h/2", "http://h/3"]


def test_seeds(frame):
    text = one(frame, "h/a", "http://h/a", "https://k/b")
    rows, domains = ingest_seeds(text)
    assert {(r.url, r.host, r.force) for r in rows.collect()} == {
        ("http://h/a", "h", True), ("http://https://k/b", "https", True),
    }
    assert sorted(r.domain for r in domains.collect()) == ["h", "https"]
    rows, domains = ingest_seeds(text, strict_quirk=False)
    assert urls(rows) == ["http://h/a", "https://k/b"]
    assert [(r.enabled, r.crawl_delay) for r in domains.collect()] == [(True, None)] * 2


def one_by_one(arrivals, delay, state=None):
    """The slots, worked out request by request in microseconds."""
    free, out = dict(state or {}), {}
    for host, t, i in sorted(arrivals):
        v = free.get(host)
        start = t if v is None or v <= t else v + delay
        free[host] = start + delay if start == t else start
        out[host, i] = start
    return out, free


def slots(frame, arrivals, delay, state=None, blocks=None):
    rows = [(h, datetime.fromtimestamp(t / 1e6, timezone.utc), i) for h, t, i in arrivals]
    state = None if state is None else frame(list(state.items()), "host string, free_us long")
    got, left = polite_slots(frame(rows, "host string, at timestamp, i int"), delay / 1e6, tie=["i"], state=state, blocks=blocks)
    starts = {(r.host, r.i): r.us for r in got.select("host", "i", F.unix_micros("start_at").alias("us")).collect()}
    return starts, {r.host: r.free_us for r in left.collect()}


SECOND = 1_000_000


@pytest.mark.parametrize("at, want", [([0, 0, 0], [0, 2, 3]), ([0, 1, 5], [0, 1, 5]), ([0, 0.5, 10], [0, 2, 10])])
def test_slot_examples(frame, at, want):
    got, _ = slots(frame, [("h", int(t * SECOND), i) for i, t in enumerate(at)], SECOND)
    assert [got["h", i] for i in range(3)] == [w * SECOND for w in want]


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_slots_with_one_large_host(frame, blocks):
    rng = random.Random(blocks)
    arrivals = [(rng.choice(["hot"] * 5 + ["a", "b", "c"]), rng.randrange(0, 900) * SECOND, i) for i in range(900)]
    state = {"hot": 50 * SECOND, "b": 2000 * SECOND, "idle": 7}
    for given in (None, state):
        assert slots(frame, arrivals, SECOND, given, blocks) == one_by_one(arrivals, SECOND, given)


def test_slots_keep_their_distance(frame):
    arrivals = [("h", t * SECOND // 3, t) for t in range(100)]
    starts = sorted(slots(frame, arrivals, SECOND, blocks=7)[0].values())
    assert all(b - a >= SECOND for a, b in zip(starts, starts[1:]))


def test_long_queues_do_not_overflow(frame):
    day = 86_400 * SECOND
    starts, _ = slots(frame, [("h", 0, i) for i in range(3000)], day, blocks=3)
    assert max(starts.values()) == 3000 * day
