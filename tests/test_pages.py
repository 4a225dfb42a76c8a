import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from webframe import schemas
from webframe.functions import html as H
from webframe.operators.content import decode_content, lower_headers, with_html, with_raw_len
from webframe.operators.links import (
    CSS_SCHEMA,
    css_extract,
    extract_links,
    link_edges,
    map_pages,
    page_links,
    page_nofollow,
    redirect_links,
)


def response(url="http://h/p/q", code=200, headers=None, body=b""):
    return (url, code, headers or {}, body, 0.1, None)


@pytest.fixture
def responses(frame):
    return lambda *rows: frame(list(rows), schemas.RESPONSES)


def test_decode(responses):
    def typed(ct, body, code=200):
        return response(code=code, headers={"content-type": ct} if ct else {}, body=body)

    rows = [
        (typed("text/html", b"x", 404), None, None, None),
        (typed(None, b"x"), "text/plain", "utf-8", "x"),
        (typed("text/html; charset=iso-8859-1", b"\xe9"), "text/html", "iso-8859-1", "é"),
        (typed("text/html;q=1; Charset= latin-1 ", b"\xe9"), "text/html", "latin-1", "é"),
        (typed("text/html; charset=utf-8", b"a\xe9b"), "text/html", "utf-8", "ab"),
        (typed("text/html; charset=", "é".encode()), "text/html", "utf-8", "é"),
        (typed("text/html; charset=nope", b"a"), "text/html", "nope", None),
        (typed('text/html; charset="utf-8"', b"a"), "text/html", '"utf-8"', "a"),  # Python reads such names
        (typed("text/html; charset", b"a"), "text/html", None, None),
        (typed("text/html; charset=windows-1252", b"\x80"), "text/html", "windows-1252", "€"),
        (typed("text/html; charset=ascii", b"a\x80b"), "text/html", "ascii", "ab"),
        (typed("text/html; charset=utf-8", b""), "text/html; charset=utf-8", None, None),
        (typed("text/html; charset=utf-8", None), "text/html; charset=utf-8", None, None),
        (response(code=None, body=None), None, None, None),
    ]
    got = decode_content(responses(*[r[0] for r in rows])).select("content_type", "charset", "content").collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_html_of_any_code_and_charset(responses):
    rows = [response(code=404, body=b"a"), response(headers={"content-type": "x; charset=nope"}, body="é".encode())]
    rows.append(response(headers={"content-type": "x; charset=latin1"}, body=b"\xe9"))
    for df in (responses(*rows), decode_content(responses(*rows))):
        assert [r.html for r in with_html(df).collect()] == ["a", "é", "é"]


def test_raw_len(responses):
    rows = [
        (response(headers={"content-length": "12"}, body=b"abc"), 12),
        (response(headers={"content-length": " 7 "}, body=b"abc"), 7),
        (response(headers={"content-length": "n/a"}, body=b"abc"), 3),
        (response(headers={"content-length": "1.5"}, body=b"abc"), 3),
        (response(body=None), 0),
    ]
    assert [r.raw_len for r in with_raw_len(responses(*[r[0] for r in rows])).collect()] == [r[1] for r in rows]


def test_lower_headers(responses):
    got = lower_headers(responses(response(headers={"Content-Type": "a", "X": "1", "x": "2"}))).collect()[0].headers
    assert got == {"content-type": "a", "x": "1,2"}


def test_links(frame):
    a = '<a href="/x">'
    rows = [
        (a + a, ["http://h/x"] * 2),
        ('<a rel="NoFollow" href="/n">', []),
        ('<a rel="nofollow noopener" href="/n">', ["http://h/n"]),
        ('<a href=""><a><a name=q>', []),
        ("<!-- " + a + " --><script>" + a + "</script><STYLE>" + a + "</style >", []),
        ('<meta name="robots" content="nofollow">' + a, []),
        (a + '<META NAME=Robots CONTENT="NOINDEX,NOFOLLOW">', []),
        ('<meta name="robots" content="noindex, nofollow">' + a, ["http://h/x"]),
        ("<A HREF='c?a=1&amp;b=2#z'>", ["http://h/p/c?a=1&b=2"]),
        ('<a href="/a&#000000000038;b">', ["http://h/a&b"]),
        ('<a href="/a&#x0000000026;b&#38c&#x26">', ["http://h/a&b&c&"]),
        ('<a href="/&apos;&NotEqualTilde;&amp&nosuch;&#99999999999999999999;">', ["http://h/'\u2242\u0338&amp&nosuch;&"]),
        ('<a href="mailto:x"><a href=javascript:0><a href=HTTP://k/>', ["http://k/"]),
        ('<html xmlns="http://www.w3.org/1999/xhtml">' + a, ["http://h/x"]),
        ('<a href="/unclosed', []),
        ("", []),
        (None, []),
    ]
    pages = frame([("http://h/p/q", h) for h, _ in rows], "url string, html string")
    assert [r.links for r in extract_links(pages).collect()] == [r[1] for r in rows]
    marked = [r.nofollow for r in page_nofollow(pages).collect()]
    assert marked == [i in (5, 6) for i in range(len(rows))]


class Parser(HTMLParser):
    def __init__(self):
        super().__init__()
        self.hrefs, self.nofollow = [], False

    def handle_starttag(self, tag, attrs):
        d = {}
        for k, v in attrs:
            d.setdefault(k, v)
        if tag == "a" and d.get("href") and (d.get("rel") or "").lower() != "nofollow":
            self.hrefs.append(d["href"])
        if tag == "meta" and (d.get("name") or "").lower() == "robots":
            self.nofollow |= "nofollow" in (d.get("content") or "").lower().split(",")


BITS = [
    '<a href="/x">', "<a href=/y>", "<A HREF='/z?a=1&amp;b=2'>", '<a rel="NoFollow" href="/n">', "text ", "</a>", "<b>", "é",
    '<a href="/o" rel="nofollow noopener">', '<a title="a > b href=/bad" href="/g">', '<a class=k data-href="/no" href="/h"/>',
    '<a href="">', "<a>", "<a name=q>", '<!-- <a href="/c1"> -->', '<script>var a="<a href=/s>";</script>', "<style>a{}</style>",
    '<STYLE> <a href="/st"> </STYLE >', '<abbr href="/ab">', '<meta name="robots" content="index">', "<br/>",
    '<meta name=ROBOTS content="noindex, nofollow">', '<a\nhref = "/nl"\n>', '<a href="&#233;&eacute;&#x41;&bogus;">',
    '<a href="/d1" href="/d2">', "<a download href=/dl>", "<a href=/u rel=nofollow>", "<meta charset=utf-8>",
]


def test_tags_as_the_standard_parser(spark):
    rng = random.Random(3)
    pages = [("".join(rng.choices(BITS, k=rng.randint(0, 12))),) for _ in range(3000)]
    tags = spark.createDataFrame(pages, "html string").withColumn("t", H.link_tags(F.col("html")))
    for r in tags.select("html", H.hrefs(F.col("t")).alias("hrefs"), H.nofollow(F.col("t")).alias("nofollow")).collect():
        want = Parser()
        want.feed(r.html)
        assert (r.hrefs, r.nofollow) == (want.hrefs, want.nofollow), r.html


def test_long_odd_pages_take_linear_time(frame):
    odd = ["<a " * 100_000, "<a x='" * 50_000, "<!-- <script " * 50_000, "&" * 200_000, '<a href="' + "&amp;" * 20_000 + '">']
    tags = frame([(t,) for t in odd], "html string").select(H.hrefs(H.link_tags(F.col("html"))).alias("h"))
    assert [len(r.h) for r in tags.collect()] == [0, 0, 0, 0, 1]


def test_redirects(responses):
    rows = [
        (response(code=301, headers={"location": "/x"}), "http://h/x"),
        (response(code=302, headers={"location": "http://k/y#z"}), "http://k/y#z"),
        (response(code=302, headers={"location": "r#z"}), "http://h/p/r#z"),
        (response(code=399), None),
        (response(code=200, headers={"location": "/x"}), None),
        (response(code=None), None),
    ]
    assert [r.redirect for r in redirect_links(responses(*[r[0] for r in rows])).collect()] == [r[1] for r in rows]


def test_page_links_put_the_redirect_first(responses):
    df = page_links(responses(response(code=301, headers={"location": "/r"}, body=b'<a href="/x">')))
    assert df.collect()[0].links == ["http://h/r", "http://h/x"]
    assert [tuple(r) for r in link_edges(df).collect()] == [("http://h/p/q", "http://h/r", 0), ("http://h/p/q", "http://h/x", 1)]


def test_map_pages(frame):
    body = """<div class="info big"><p>no<p class='content'>x<h1> A &amp; <b>B</b></h1>
        <ul><li><a href="/1">1</a><li><a>2</a></ul></div><h1>out</h1><li><a href="/out"></a>"""
    rows = [("http://www.pin.com/me/", body), ("http://www.pin.com/me/x", body), ("http://pin.com/you/", "<p>none"), ("http://pin.com/a/", None)]
    got = map_pages(
        frame(rows, "url string, body string"), r"^http://[^/]*pin\.com/[^/]+/$", css_extract(".info .content"), CSS_SCHEMA
    )
    assert [tuple(r) for r in got.collect()] == [("http://www.pin.com/me/", "A & B", ["/1", None])]
