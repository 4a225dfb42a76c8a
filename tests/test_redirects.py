from datetime import datetime

import pytest

from webframe import schemas
from webframe.operators import links
from webframe.operators.redirects import replay_followed, resolve_redirects

REDIRECTS = "url string, redirect string"


def plain(edges, most):
    out = {}
    for url in edges:
        at, hops, passed = url, 0, set()
        while at in edges and at not in passed:
            passed.add(at)
            at, hops = edges[at], hops + 1
        if at not in edges and hops <= most:
            out[url] = (at, hops, "final")
        else:
            out[url] = (None, None, "loop" if at in edges and hops <= most else "long")
    return out


def test_chains_and_loops_of_any_length(frame):
    edges = {f"c{i}": f"c{i + 1}" for i in range(1000)}  # a chain of 1000
    edges |= {f"l{i}": f"l{(i + 1) % 7}" for i in range(7)} | {"l-in": "l3", "l-in2": "l-in"}  # a loop and a way into it
    edges |= {"self": "self"} | {f"hot{i}": "door" for i in range(300)} | {"door": "c990"}
    got = {r.url: (r.target, r.hops, r.state) for r in resolve_redirects(frame([*edges.items()], REDIRECTS)).collect()}
    assert got == plain(edges, 1024)


@pytest.mark.parametrize("most", [1, 5, 8])
def test_limit(frame, most):
    edges = {f"c{i}": f"c{i + 1}" for i in range(20)} | {"a": "b", "b": "a"}
    got = {r.url: (r.target, r.hops, r.state) for r in resolve_redirects(frame([*edges.items()], REDIRECTS), most).collect()}
    want = plain(edges, most)
    assert {u: v for u, v in got.items() if u[0] == "c"} == {u: v for u, v in want.items() if u[0] == "c"}
    assert got["a"][0] is None and (most == 1 or got["a"][2] == "loop")


def test_odd_redirects(frame):
    rows = [("a", "c"), ("a", "b"), ("a", "b"), (None, "x"), ("n", None)]
    assert [tuple(r) for r in resolve_redirects(frame(rows, REDIRECTS)).collect()] == [("a", "b", 1, "final")]
    assert resolve_redirects(frame([], REDIRECTS)).count() == 0


def test_replay_of_where_urls_lead(frame):
    time = datetime(2024, 1, 1)
    moved = lambda url, to: (url, 301, {"location": to}, b"", 0.1, time)
    archive = frame(
        [moved("http://h/a", "/b"), moved("http://h/b", "http://g/c"), ("http://g/c", 200, {}, b"page", 0.1, time), moved("http://h/x", "/y"), moved("http://h/y", "/x")],
        schemas.RESPONSES,
    )
    batch = frame([(u,) for u in ("http://h/a", "http://g/c", "http://h/x", "http://h/none")], "url string")
    got = {r.url: (r.final_url, r.code) for r in replay_followed(batch, archive).collect()}
    assert got == {
        "http://h/a": ("http://g/c", 200), "http://g/c": ("http://g/c", 200), "http://h/x": ("http://h/x", 301), "http://h/none": ("http://h/none", None),
    }


def test_one_bad_page_does_not_end_a_job(frame):
    """A page nested 5000 deep passes, and one on which the job fails is told apart; whole numbers stay whole."""
    deep = "<div class=x><h1>" + "<b>" * 5000 + "deep" + "</b>" * 5000 + "</h1></div>"
    docs = frame([("http://h/1", deep), ("http://h/2", "bad"), ("http://h/3", "none"), ("http://h/4", None)], "url string, body string")

    def job(url, body):
        if body == "bad":
            raise KeyError("no such thing")
        return {"n": 2**53 + 1, "name": (links.css_extract(".x", "h1")(url, body) or {}).get("name")} if body != "none" else None

    rows, failed = links.map_pages_failed(docs, "http://h/", job, "n long, name string")
    assert [tuple(r) for r in rows.collect()] == [(2**53 + 1, "deep")]
    assert [tuple(r) for r in failed.collect()] == [("http://h/2", "KeyError: 'no such thing'")]
    assert [tuple(r) for r in links.map_pages(docs, "http://h/", job, "n long, name string").collect()] == [(2**53 + 1, "deep")]


def test_a_job_may_use_the_package_after_pages_were_decoded(frame):
    """What a job refers to goes to the workers by value, also after other operators have used it on the driver."""
    time = datetime(2024, 1, 1)
    page = "<div class=x><h1>one</h1></div>"
    responses = frame([("http://h/1", 200, {"content-type": "text/html; charset=utf-16"}, page.encode("utf-16"), 0.1, time)], schemas.RESPONSES)
    docs = links.with_html(responses).select("url", "html")
    assert [r.html for r in docs.collect()] == [page]
    job = lambda url, body: {"name": links.css_extract(".x", "h1")(url, body)["name"]}
    assert [tuple(r) for r in links.map_pages(docs, "http://h/", job, "name string", body="html").collect()] == [("one",)]
