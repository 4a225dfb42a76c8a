import random
from datetime import datetime, timedelta

from webframe import schemas
from webframe.operators import control, log, stats
from webframe.session import written
from webframe.sources.docs import append_first_wins, read_docs, replay_responses, to_docs, upsert_latest, write_docs

NOW = datetime(2024, 1, 1, 12, 0, 30)


def test_traffic(frame):
    rows = [(NOW - timedelta(minutes=m), b) for m in range(70) for b in (100, 21)] + [(NOW + timedelta(minutes=1), 1)]
    rows = [r for r in rows if r[0] != NOW - timedelta(minutes=7)]
    got = stats.traffic_stats(frame(rows, "crawl_time timestamp, raw_len long"), NOW).orderBy("bucket_ms").collect()
    assert len(got) == 60
    assert {(r.pages_per_s, r.bytes_per_s) for r in got} == {(0.0, 2)}
    assert (got[-1].bucket_ms - got[0].bucket_ms) // 60_000 == 60


def test_traffic_rates(frame):
    for n, want in ((3, 0.1), (6, 0.1), (63, 1.1), (60, 1.0)):
        df = frame([(NOW, 10)] * n, "crawl_time timestamp, raw_len long")
        row = stats.traffic_stats(df, NOW).collect()[0]
        assert (row.pages_per_s, row.bytes_per_s) == (want, n * 10 // 60)


def test_step_metrics(frame):
    rng = random.Random(5)
    times = {"A": [0.001, 0.002, 0.003, 0.004], "B": [0.003, 0.001, 0.002], "C": [rng.random() for _ in range(501)]}
    rows = [(f"pipeline:{s}:time", v, NOW) for s, vs in times.items() for v in vs]
    rows += [(f"pipeline:{s}:calls", 1.0, NOW) for s, vs in times.items() for _ in vs]
    rows += [("pipeline:D:calls", 2.0, NOW), ("response:h", 9.0, NOW), ("other", 1.0, NOW), ("pipeline:x", 1.0, NOW)]
    got = {r.step: (r.calls, r.median, r.ave) for r in stats.step_metrics(frame(rows, schemas.METRIC_EVENTS)).collect()}
    c = times["C"]
    assert got == {
        "A": (4, 3, 2), "B": (3, 2, 2), "D": (2, None, None),
        "C": (501, int(sorted(c)[250] * 1000), int(sum(c) / 501 * 1000)),
    }


def test_response_times(frame):
    rows = [("response:h:8", v, NOW) for v in (0.1, 0.2, 0.105)] + [("pipeline:a:time", 1.0, NOW)]
    got = stats.response_time_by_host(frame(rows, schemas.METRIC_EVENTS)).collect()
    assert [tuple(r) for r in got] == [("h:8", 0.14)]


def test_log(frame):
    rows = frame([("http://h/", 200), ("http://k/", None)], "url string, code int")
    assert [r.message for r in log.crawl_log(rows).collect()] == ["Crawled 200 http://h/", "NOT Crawled http://k/"]
    assert [r.message for r in log.seed_log(rows).collect()] == ["Added http://h/", "Added http://k/"]


def test_log_tail(frame):
    start = datetime(2024, 1, 1)
    df = frame([(start + timedelta(seconds=i), f"m{i}") for i in range(250)], schemas.LOG)
    assert [r.message for r in log.log_tail(df).collect()] == [f"m{i}" for i in range(50, 250)]
    token = 1_704_067_200_000 + 245_000
    got = log.log_tail(df, token).collect()
    assert [tuple(r) for r in got[:1]] == [(1_704_067_446.0, "2024-01-01 00:04:06", "m246")] and len(got) == 4
    assert [r.message for r in log.log_tail(df, shown=20).collect()] == [f"m{i}" for i in range(230, 250)]
    assert log.log_tail(df, token - 240_000).count() == 200


def test_rules_listing(frame):
    rows = [("1", "b", 1, True, "/"), ("2", "a", 2, True, "/"), ("3", "a", 1, True, "/z"), ("4", "a", 1, True, "/a"),
            ("5", "a", 1, False, "/a"), ("6", "B", 1, True, "/")]
    df = frame(rows, schemas.CUSTOM_RULES)
    assert [r.id for r in control.rules_listing(df).collect()] == ["6", "5", "4", "3", "2", "1"]
    assert [r.id for r in control.rules_listing(df, "UNICODE").collect()] == ["5", "4", "3", "2", "1", "6"]


def test_domain_changes(frame):
    df = frame([("kept", False, 2.0), ("gone", True, None), ("again", False, 1.0)], schemas.DOMAINS)
    rows = [(1, "add", "kept"), (2, "delete", "gone"), (3, "delete", "again"), (4, "add", "again"), (5, "add", "new"),
            (6, "add", "new"), (7, "add", "brief"), (8, "delete", "brief"), (9, "delete", "unknown")]
    got = control.apply_domain_changes(df, frame(rows, "seq long, action string, domain string"))
    assert sorted(tuple(r) for r in got.collect()) == [("again", True, None), ("kept", False, 2.0), ("new", True, None)]
    own = frame([(1, "add", "slow", False, 2.5)], "seq long, action string, domain string, enabled boolean, crawl_delay double")
    assert ("slow", False, 2.5) in [tuple(r) for r in control.apply_domain_changes(df, own).collect()]


def test_rule_changes(frame):
    df = frame([("1", "h", 1, True, "/"), ("2", "h", 2, True, "/x")], schemas.CUSTOM_RULES)
    rows = [(1, "delete", "1", None, None, None, None), (2, "add", "3", "h", 7, 1, "/y"), (3, "add", "4", "h", None, None, "/z")]
    changes = frame(rows, "seq long, action string, id string, site string, ord long, flag int, path string")
    got = {r.id: r for r in control.apply_rule_changes(df, changes).collect()}
    assert sorted(got) == ["2", "3", "4"]
    assert tuple(got["3"]) == ("3", "h", 7, True, "/y")
    assert got["4"].flag is False and got["4"].ord > 1_700_000_000


DOC = "url string, code int, body string, crawl_time timestamp"


def version(url, second, body="b", code=200):
    return (url, code, body, datetime(2024, 1, 1) + timedelta(seconds=second))


def test_first_and_latest_wins(frame):
    stored = frame([version("a", 5, "stored"), version("b", 5, "stored")], DOC)
    new = frame([version("a", 9, "a9"), version("c", 2, "c2"), version("c", 1, "c1"), version("b", 1, "b1")], DOC)
    assert [r.body for r in append_first_wins(stored, new).collect()] == ["c1"]
    assert sorted(r.body for r in upsert_latest(stored, new).collect()) == ["a9", "c2", "stored"]


def test_ties_are_settled_alike_in_any_order(frame):
    rows = [version("a", 1, f"b{i}", 200 + i % 2) for i in range(20)]
    none = frame([], DOC)
    picks = {append_first_wins(none, frame(r, DOC)).collect()[0].body for r in (rows, rows[::-1], rows[7:] + rows[:7])}
    assert len(picks) == 1


def test_store_reads_one_domain_from_its_folder(frame, tmp_path):
    rows = [(f"http://{h}/{i}", 200, f"b{i}", [f"l{i}"], {"k": "v"}, "text/html", NOW) for h in "abc" for i in range(4)]
    rows.append(("http://d/", None, None, [], {}, None, None))
    df = frame(rows, "url string, code int, content string, links array<string>, headers map<string,string>, "
                     "content_type string, crawl_time timestamp")  # fmt: skip
    path = str(tmp_path / "docs")
    write_docs(to_docs(df), path)
    spark = df.sparkSession
    assert read_docs(spark, path).count() == 12
    assert {r.domain for r in read_docs(spark, path).collect()} == {"a", "b", "c"}
    one = read_docs(spark, path, "a")
    assert one.count() == 4
    assert "PartitionFilters: [isnotnull(domain_bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_replay(frame):
    archive = frame([version("a", 1, "old"), version("a", 2, "new"), version("x", 1)], DOC)
    got = replay_responses(frame([("a", 1), ("b", 2)], "url string, rn int"), archive).orderBy("url").collect()
    assert [(r.url, r.rn, r.body) for r in got] == [("a", 1, "new"), ("b", 2, None)]


def test_bodies_are_moved_only_after_urls_are_matched(frame, spark, tmp_path):
    """An archive and a store of their own files: they are cut down by a broadcast of urls before any exchange."""
    docs = frame([version(f"http://h/{i}", i) for i in range(90)], DOC)
    docs.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.schema(docs.schema).parquet(str(tmp_path / "docs"))
    batch = written(frame([("http://h/3", 1)], "url string, rn int"), "batch")
    new = written(frame([version("http://h/3", 100, "later"), version("http://h/x", 1)], DOC), "new")
    for df in (replay_responses(batch, stored), upsert_latest(stored, new), append_first_wins(stored, new)):
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        for i, line in enumerate(plan):
            if "FileScan parquet" in line and "test_bodies" in line:  # the archive or the store
                below = [x for x in plan[:i] if len(x) - len(x.lstrip(" :|+-")) < len(line) - len(line.lstrip(" :|+-"))]
                above = [x for x in below if "Exchange hashpartitioning" in x or "BroadcastHashJoin" in x]
                assert "BroadcastHashJoin" in above[-1], "\n".join(plan)
    latest = {r.url: r.body for r in upsert_latest(stored, new).collect()}
    assert len(latest) == 91 and latest["http://h/3"] == "later"
