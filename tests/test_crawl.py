import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from webframe import schemas
from webframe.operators import robots as R
from webframe.operators.stats import step_metrics
from webframe.operators.steps import Step, row_step, run_pipeline
from webframe.plans import closure as C
from webframe.plans import loop as L
from webframe.plans.crawl import crawl_round, default_steps
from webframe.plans.queries import QUERIES
from webframe.session import work_folder
from webframe.settings import CrawlSettings
from webframe.sources.docs import read_docs


def no_rules(frame):
    return R.rule_lists(R.select_ruleset(R.parse_robots(frame([], schemas.ROBOTS_TXT))))


def breadth_first(seeds, edges, stopped, host_ok):
    rounds, front, n = {s: 0 for s in seeds}, set(seeds), 0
    while front:
        n += 1
        front = {d for s, d, _ in edges if s in front and s not in stopped and host_ok(d) and d not in rounds}
        rounds.update({u: n for u in front})
    return {(u, n, u not in stopped) for u, n in rounds.items()}


@pytest.fixture
def graph():
    rng = random.Random(11)
    nodes = [f"http://h{i % 4}/{i}" for i in range(60)]
    edges = [(s, rng.choice(nodes), p) for s in nodes for p in range(rng.choice([0, 1, 2, 9]))]
    edges += [(nodes[0], d, 20 + p) for p, d in enumerate(nodes[10:50])]  # one page with very many links
    return nodes, edges


@pytest.mark.parametrize("run, partitions, rewrite", [(100_000, 8, 4), (4, 3, 1), (1, 1, 2)])
def test_closure(frame, spark, graph, monkeypatch, run, partitions, rewrite):
    nodes, edges = graph
    monkeypatch.setattr(C, "RUN", run)
    monkeypatch.setattr(C, "REWRITE_FROM", rewrite)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        custom = R.custom_ruleset(frame([("1", "h1", 1, False, "/1")], schemas.CUSTOM_RULES))
        rules = R.select_ruleset(R.parse_robots(frame([], schemas.ROBOTS_TXT)))
        domains = frame([(f"h{i}", True, None) for i in range(3)], schemas.DOMAINS)
        got = C.crawl_closure(frame([(nodes[0],)], "url string"), frame(edges, schemas.EDGES), domains, rules, custom)
        stopped = {n for n in nodes if n.startswith("http://h1/1")}
        want = breadth_first([nodes[0]], edges, stopped, lambda d: not d.startswith("http://h3/"))
        assert {tuple(r) for r in got.collect()} == want
        assert len({n for _, n, _ in want}) > 2
        left = [t.name for t in spark.catalog.listTables() if t.name.startswith("webframe_reached")]
        assert not left
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_closure_of_a_long_chain_keeps_few_files(frame, spark, monkeypatch):
    monkeypatch.setattr(C, "MERGE_EVERY", 4)
    folders = []
    monkeypatch.setattr(C, "new_folder", lambda spark, name: folders.append(f"{work_folder(spark)}/chain") or folders[0])
    most = []
    repeat = C.robots_allowed
    count = lambda: sum(len([f for f in names if f.endswith(".parquet")]) for _, _, names in os.walk(folders[0]))
    monkeypatch.setattr(C, "robots_allowed", lambda *a: most.append(count()) or repeat(*a))
    n = 30
    edges = [(f"http://h/{i}", f"http://h/{i + 1}", 0) for i in range(n)]
    args = (frame([("http://h/0",)], "url string"), frame(edges, schemas.EDGES), frame([("h", True, None)], schemas.DOMAINS), no_rules(frame))
    got = C.crawl_closure(*args)
    assert {(r.url, r.round) for r in got.collect()} == {(f"http://h/{i}", i) for i in range(n + 1)}
    assert max(most) <= 8 + 8 + 5 and count() <= 8 + 5  # links, merged rounds, single ones


def test_closure_that_breaks_off_leaves_nothing(frame, spark, graph, monkeypatch):
    nodes, edges = graph
    folder = f"{work_folder(spark)}/broken"
    monkeypatch.setattr(C, "new_folder", lambda spark, name: folder)
    monkeypatch.setattr(C, "restrict_links", lambda edges, *a, **k: edges)
    calls = []
    repeat = C.robots_allowed
    monkeypatch.setattr(C, "robots_allowed", lambda *a: calls.append(1) or (repeat(*a) if len(calls) < 3 else 1 / 0))
    args = (frame([(nodes[0],)], "url string"), frame(edges, schemas.EDGES), frame([], schemas.DOMAINS), no_rules(frame))
    with pytest.raises(ZeroDivisionError):
        C.crawl_closure(*args)
    assert not [f for _, _, names in os.walk(folder) for f in names]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("webframe_")]


def test_closure_limits(frame, graph):
    nodes, edges = graph
    args = (frame([(nodes[0],)], "url string"), frame(edges, schemas.EDGES), frame([], schemas.DOMAINS), no_rules(frame))
    assert C.crawl_closure(*args).count() == 1
    everywhere = C.crawl_closure(*args, settings=CrawlSettings(mode="internet"), max_rounds=1)
    assert {r.round for r in everywhere.collect()} == {0, 1}
    assert C.crawl_closure(*args, settings=CrawlSettings(mode="internet", follow_links=False)).count() == 1


def test_bucketed_links_are_joined_without_a_shuffle(frame, spark, graph, monkeypatch):
    _, edges = graph
    links, _ = C._bucketed_edges(frame(edges, schemas.EDGES), f"{work_folder(spark)}/bucketed", [])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        front = frame([("http://h0/0",)], "src string")
        plan = links.join(C._runs(front, None), ["src", "run"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("rows, buckets", [(None, 1), (40, 4), (1, 8)])
def test_a_round_has_as_many_buckets_as_its_tables_need(frame, spark, graph, monkeypatch, rows, buckets):
    """Not one for each of the session's 8 shuffle partitions, however little a round finds."""
    nodes, edges = graph
    if rows:
        monkeypatch.setattr(C, "ROWS_PER_BUCKET", rows, raising=False)
    monkeypatch.setattr(C, "MERGE_EVERY", 2)
    found, others = set(), {t.name for t in spark.catalog.listTables()}
    repeat = C.robots_allowed

    def look(*a):
        for t in spark.catalog.listTables():
            if t.name not in others:
                described = spark.sql(f"DESCRIBE EXTENDED {t.name}").filter("col_name = 'Num Buckets'")
                found.update(int(r.data_type) for r in described.collect())
        return repeat(*a)

    monkeypatch.setattr(C, "robots_allowed", look)
    edges = [e for e in edges if not e[1].startswith("http://h3/")]
    edges = edges[:130] + [(nodes[0], d, 90 + p) for p, d in enumerate(nodes[1:3])]
    domains = frame([(f"h{i}", True, None) for i in range(4)], schemas.DOMAINS)
    got = C.crawl_closure(frame([(nodes[0],)], "url string"), frame(edges, schemas.EDGES), domains, no_rules(frame))
    assert {tuple(r) for r in got.collect()} == breadth_first([nodes[0]], edges, set(), lambda d: True)
    assert found == {buckets}
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def odd_stop(df):
    return df.withColumn("stop", F.col("i") % 2 == 1)


def broken(df):
    return df.select("nothing")


def test_steps(frame):
    half = Step("half", lambda df: df.withColumn("i", F.col("i") * 10).withColumn("failed", F.col("i") == 40))
    label = Step("label", lambda df: df.withColumn("label", F.lit("x")))
    df = frame([(i,) for i in range(6)], "i int")
    for kw in ({}, {"keep_gates": True}):
        got = run_pipeline(df, [label, "tests.test_crawl.odd_stop", broken, half], **kw)
        assert sorted((r.i, r.label, r.stopped_by) for r in got.collect()) == [
            (0, "x", None), (1, "x", "odd_stop"), (3, "x", "odd_stop"), (4, "x", None), (5, "x", "odd_stop"), (20, "x", None),
        ]


def test_stopped_rows_skip_later_steps(frame):
    later = Step("later", lambda df: df.withColumn("late", F.lit(1)))
    got = run_pipeline(frame([(i,) for i in range(4)], "i int"), [odd_stop, later]).collect()
    assert {(r.i, r.late) for r in got} == {(0, 1), (2, 1), (1, None), (3, None)}


def test_a_row_that_fails_goes_on_unchanged(frame):
    def user(row):
        if row.i == 2:
            raise ValueError("bad row")
        return None if row.i == 3 else {"i": row.i * 10, "twice": 2 * row.i, "stop": row.i == 1}

    steps = [row_step("user", user, "i int, twice int, stop boolean"), Step("last", lambda df: df.withColumn("end", F.lit(1)))]
    for timed in (False, True):
        got = run_pipeline(frame([(i,) for i in range(5)], "i int"), steps, timed=timed)
        rows = (got[0] if timed else got).collect()
        assert sorted((r.i, r.twice, r.end, r.stopped_by) for r in rows if r.i > 3) == [(10, 2, None, "user"), (40, 8, 1, None)]
        assert sorted((r.i, r.twice, r.end) for r in rows if r.i <= 3) == [(0, 0, 1), (2, None, 1), (3, None, 1)]


def test_rows_name_the_steps_they_missed(frame):
    def user(row):
        return {"i": row.i // (row.i - 2)}

    narrow = Step("narrow", lambda df: df.select("i", "stopped_by"))
    for steps, marks in (([broken, odd_stop, row_step("user", user, "i int")], {1: ["broken"], 2: ["broken", "user"], 0: ["broken"]}), ([broken, narrow], dict.fromkeys(range(3), ["broken"]))):
        for timed in (False, True):
            got = run_pipeline(frame([(i,) for i in range(3)], "i int"), steps, timed=timed)
            assert {r.i: r.failed_steps for r in (got[0] if timed else got).collect()} == marks
    assert [r.failed_steps for r in run_pipeline(frame([(1,)], "i int"), [odd_stop]).collect()] == [[]]


def test_a_needed_step_is_never_left_out(frame):
    for timed in (False, True):
        with pytest.raises(Exception, match="nothing"):
            run_pipeline(frame([(1,)], "i int"), [Step("broken", broken, needed=True)], timed=timed)


@pytest.mark.parametrize("kw", [{}, {"timed": True}])
def test_what_fails_while_spark_runs_is_raised(frame, kw):
    """Not logged, and the step left out for all rows as if it stopped none."""
    lost = Step("lost", lambda df: df.withColumn("stop", F.raise_error(F.lit("lost a file")).cast("boolean")))
    with pytest.raises(Exception, match="lost a file"):
        run_pipeline(frame([(1,)], "i int"), [lost], **kw)


@pytest.mark.parametrize("name", ["stop_counts", "pipeline_calls", "crawl_round_log"])
def test_a_failure_of_the_robots_check_does_not_look_like_a_result(spark, monkeypatch, name):
    def fail(*a):
        raise OSError("no rules")

    monkeypatch.setattr("webframe.plans.crawl.robots_allowed", fail)
    with pytest.raises(OSError, match="no rules"):
        QUERIES[name](spark, "/root/testdata/sf0.001").collect()


def test_timed_steps(frame):
    got, events = run_pipeline(frame([(i,) for i in range(6)], "i int"), [odd_stop, Step("id", lambda d: d)], timed=True)
    assert got.count() == 6
    assert {(r.step, r.calls) for r in step_metrics(events).collect()} == {("odd_stop", 6), ("id", 3)}


def test_round(frame):
    page = b'<a href="/2"><a href="/stop"><a href="http://other/x">'
    frontier = frame([(u, "h", 1, False, None) for u in ("http://h/1", "http://h/stop", "http://h/lost")], schemas.FRONTIER)
    archive = frame([("http://h/1", 200, {}, page, 0.5, None)], schemas.RESPONSES)
    lists = R.rule_lists(
        R.select_ruleset(R.parse_robots(frame([("http://h/robots.txt", "h", 200, "User-agent: *\nDisallow: /stop")], schemas.ROBOTS_TXT)))
    )
    seen = frame([("http://h/old",)], schemas.SEEN)
    out = crawl_round(frontier, seen, frame([], schemas.DOCS), frame([("h", True, None)], schemas.DOMAINS), lists, archive)
    assert {r.message for r in out.log.collect()} == {
        "Crawled 200 http://h/1", "NOT Crawled http://h/stop", "NOT Crawled http://h/lost",
    }
    assert [r.url for r in out.frontier.collect()] == ["http://h/2"]
    assert {r.url for r in out.seen.collect()} == {"http://h/1", "http://h/stop", "http://h/lost", "http://h/old"}
    assert [(r.url, r.domain, r.links[0]) for r in out.docs.collect()] == [("http://h/1", "h", "http://h/2")]


def test_whole_crawl(frame, spark, tmp_path, graph):
    nodes, edges = graph
    pages = {n: "".join(f'<a href="{d}">' for s, d, _ in edges if s == n) for n in nodes}
    rows = [(n, 404 if n.endswith("7") else 200, {}, html.encode(), 0.5, None) for n, html in pages.items()]
    rows.append(("http://h1/robots.txt", 200, {}, b"User-agent: *\nDisallow: /1", 0.1, None))
    archive = frame(rows, schemas.RESPONSES)
    crawl = L.Crawl(spark, str(tmp_path / "crawl"), buckets=4)
    crawl.add_seeds(frame([(nodes[0],), ("h1/1",), ("h2/nowhere",)], "url string"))
    assert crawl.queued().count() == 3
    stopped = {n for n in nodes if n.startswith("http://h1/1")} | {"http://h1/1"}
    want = breadth_first([nodes[0], "http://h1/1", "http://h2/nowhere"], edges, stopped, lambda d: not d.startswith("http://h3/"))
    reached = {u for u, _, _ in want}

    assert crawl.run(archive, rounds=2) == 2
    # a round that broke off before it was closed is run again
    queue_before = {r.url for r in crawl.queued().collect()}
    last = crawl.done.runs()[-1]
    assert last == (2, 2)
    (tmp_path / "crawl" / "seen" / "run=2-2" / "_SUCCESS").unlink()
    assert crawl.next_number() == 2
    assert crawl.run(archive, rounds=1) == 1
    assert {r.url for r in crawl.queued().collect()} == queue_before
    assert crawl.run(archive) > 0
    assert crawl.run(archive) == 0
    seen = [r.url for r in crawl.seen().collect()]
    assert len(seen) == len(set(seen)) and set(seen) == reached
    docs = read_docs(spark, f"{crawl.folder}/docs").collect()
    fetched = {u for u in reached if u in pages and u not in stopped}
    assert {d.url for d in docs} == fetched | {"http://h1/robots.txt"}
    assert {d.url: d.links for d in docs}[nodes[0]] == [d for s, d, _ in edges if s == nodes[0]]
    messages = [r.message for r in crawl.table("log").collect()]
    assert sorted(m for m in messages if not m.startswith("Crawled")) == sorted(
        [f"Added {u}" for u in (nodes[0], "http://h1/1", "http://h2/nowhere")]
        + [f"NOT Crawled {u}" for u in reached if u not in fetched]
    )
    assert {r.host: r["count"] for r in crawl.summary().collect()} == {"h0": 0, "h1": 0, "h2": 0}
    calls = {r.step: r.calls for r in crawl.steps().collect()}
    assert calls["RobotCheck"] == len(reached) and calls["Fetch"] == calls["LinkExtraction"] == len(reached - stopped)
    assert crawl.table("traffic").count() == len(fetched)
    slots = crawl.table("slots").collect()
    assert {r.url for r in slots} == reached
    for host in {r.host for r in slots}:
        starts = sorted(r.start_at for r in slots if r.host == host)
        assert all((b - a).total_seconds() >= 1 for a, b in zip(starts, starts[1:]))

    # a seed is crawled again although it was seen, and nothing else is
    crawl.add_seeds(frame([(nodes[0],)], "url string"))
    assert [r.url for r in crawl.queued().collect()] == [nodes[0]]
    assert crawl.run(archive) == 1


def test_steps_store_and_batch_of_a_crawl_are_settings(frame, spark, tmp_path):
    """One url per host and round, a step of the user's own, and the latest version of a page stays."""
    link = lambda *urls: "".join(f'<a href="{u}">' for u in urls).encode()
    time = lambda second: datetime(2024, 1, 1, 0, 0, second)
    rows = [("http://h/a", 200, {}, link("/b", "/c"), 0.5, time(1)), ("http://h/b", 200, {}, b"b", 0.5, time(2)), ("http://h/c", 200, {}, b"c", 0.5, time(3))]
    mark = row_step("Mark", lambda row: {"stop": row.url.endswith("/c")}, "stop boolean")
    settings = CrawlSettings(host_batch=1, store="latest")
    crawl = L.Crawl(spark, str(tmp_path / "crawl"), settings, lambda *given: [mark, *default_steps(*given)], buckets=4)
    crawl.add_seeds(frame([("http://h/a",)], "url string"))
    assert crawl.run(frame(rows, schemas.RESPONSES)) == 3
    assert {r.url for r in crawl.docs().collect()} == {"http://h/a", "http://h/b"}
    assert crawl.traffic(time(50), 5).first().bytes_per_s == (len(rows[0][3]) + 1) // 60
    crawl.add_seeds(frame([("http://h/b",)], "url string"))
    newer = frame([*rows, ("http://h/b", 200, {}, b"newer", 0.5, time(9))], schemas.RESPONSES)
    assert crawl.run(newer) == 1
    assert {r.url: r.body for r in crawl.docs().collect()}["http://h/b"] == "newer"
    with pytest.raises(ValueError):
        L.Crawl(spark, "x", CrawlSettings(store="none"))
