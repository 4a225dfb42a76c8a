from urllib.parse import unquote, urljoin

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webframe.functions import url as U
from webframe.operators.urls import resolve_urls, robots_urls, with_url_parts


def test_url_parts(frame):
    rows = [
        ("http://h", "http", "h", "/"),
        ("HTTP://Host.com:80/a;x=1?q#f", "http", "Host.com", "/a"),
        ("http://u:p@h/x", "http", "u", "/x"),
        ("http://u:p@h:8/a b", "http", "u:p@h:8", "/a b"),
        ("https://[::1]:8/y", "https", "[::1]:8", "/y"),
        ("mailto:a@b", "mailto", "", "a@b"),
        ("http://h/;x", "http", "h", "/"),
        ("//h/a", "", "h", "/a"),
    ]
    got = with_url_parts(frame([(r[0],) for r in rows], "url string")).collect()
    assert [tuple(r) for r in got] == rows


def test_resolve_keeps_web_urls(frame):
    rows = [
        ("http://h/a/b", "../c", "http://h/c"),
        ("http://h/a", "#x", "http://h/a"),
        ("http://h/a", "mailto:x", None),
        ("http://h/a", "HTTPS://k", None),
        ("https://h/a", "//k/b", "https://k/b"),
        ("http://h/a", "?q", "http://h/a?q"),
        ("http://h/a", "/x#y", "http://h/x"),
        ("http://h/a", "//[k/b", None),
    ]
    got = resolve_urls(frame([r[:2] for r in rows], "base string, href string"))
    assert [tuple(r) for r in got.collect()] == [r for r in rows if r[2]]


def test_robots_urls(frame):
    urls = [("http://h:80/a",), ("http://h/b",), ("https://h/a",)]
    got = {tuple(r) for r in robots_urls(frame(urls, "url string")).collect()}
    assert got == {("http://h/robots.txt", "h"), ("https://h/robots.txt", "h")}


BASES = [
    "http://h/a/b", "http://h", "https://h.com:8/a/b/?q=1", "http://h/a;p?x#f", "http://h/a/../b", "http://u:p@h/x/",
    "https://h/a//b/c", "http://h?q", "http://h/a/;p", "http://h/a;",
]
BITS = ["a", "b", "..", ".", "/", "//", "?", "q=1", "#", "f", ";", "p", "http:", "https:", "HTTP:", "x.com", ":8", " ", "é",
        "%2F", "mailto:", "&", "=", "\t"]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(BASES), st.lists(st.sampled_from(BITS), max_size=7).map("".join)), min_size=200, max_size=400))
def test_resolve_as_the_standard_library(spark, rows):
    df = spark.createDataFrame(rows, "base string, href string").withColumn("b", U.base_parts(F.col("base")))
    for r in df.select("base", "href", U.resolve(F.col("b"), F.col("href")).alias("got")).collect():
        assert r.got == urljoin(r.base, r.href), (r.base, r.href)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "/", "%", "%41", "%2f", "%2F", "%e9%zz", "%C3%A9", "+", "=", "é"]), max_size=8).map("".join), min_size=50, max_size=200))
def test_full_target_decodes_as_the_standard_library(spark, paths):
    df = spark.createDataFrame([("http://h/" + p + "?x=" + p,) for p in paths], "url string")
    for r in df.select("url", U.full_target(F.col("url")).alias("got")).collect():
        text = r.url.removeprefix("http://h").replace("%2f", "%252F").replace("%2F", "%252F")
        assert r.got == unquote(text), r.url
