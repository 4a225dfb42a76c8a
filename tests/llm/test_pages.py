"""WARC archives and main text of pages."""

import gzip
import hashlib
import json
import os
import random

import pyarrow as pa
import pytest

from webframe.llm import html_paths, warc
from webframe.llm.shared import new_folder

PAGES = "page_id long, url string, html string"


def archived(spark, pages, **options):
    raw, folder = new_folder(spark, "warc-raw"), new_folder(spark, "warc")
    warc.write_archives(warc.records(pages, **options), raw, per_file=7)
    count = warc.normalise(spark, raw, folder)
    return raw, folder, count


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", f"<p>{i}{'é' * rng.randint(0, 900)}</p>") for i in range(40)]
    rows += [(100 + i, "http://h/same", "<p>" + "same " * 300) for i in range(9)]
    rows += [(200 + i, "http://h/short", "<p>short") for i in range(3)]
    rows += [(300, None, None), (301, "", ""), (302, "http://h/a\r\nb", "x" * 200_000 + "\r\n\r\nWARC/1.1\r\n\r\n")]
    return spark.createDataFrame(rows, PAGES), rows


def test_round_trip(spark, pages):
    df, rows = pages
    raw, folder, count = archived(spark, df)
    assert count == len(rows)
    read = warc.read_records(warc.read_index(spark, folder), folder)
    got = {r.record_id[len("<urn:webframe:page:") : -1]: r for r in read.collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        r, payload = got[str(i)], (html or "").encode()
        assert r.payload_digest == "sha1:" + hashlib.sha1(payload).hexdigest() and r.payload_bytes == len(payload)
        if 100 <= i < 108:
            assert r.record_type == "revisit" and r.refers_to == "<urn:webframe:page:108>" and r.payload == b""
        else:
            assert r.record_type == "response" and r.refers_to is None and r.payload == payload
    assert got["302"].target_uri == "http://h/a%0D%0Ab" and got["300"].target_uri == ""


def test_every_record_is_a_member(spark, pages):
    df, rows = pages
    raw, folder, _ = archived(spark, df)
    seen = 0
    for name in os.listdir(folder):
        if name.endswith(".warc.gz"):
            with open(f"{folder}/{name}", "rb") as f, open(f"{folder}/{name}.idx") as idx:
                data, entries, at = f.read(), [json.loads(x) for x in idx], 0
            for e in entries:
                assert e["offset"] == at
                at += e["length"]
                member = gzip.decompress(data[e["offset"] : at])
                assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")
            assert at == len(data)
            seen += len(entries)
            whole = gzip.decompress(data)
            assert any(gzip.decompress(open(f"{raw}/{x}", "rb").read()) == whole for x in os.listdir(raw) if x.endswith(".gz"))
    assert seen == len(rows) and not [x for x in os.listdir(folder) if x.startswith(".")]


def test_damaged_and_joined_streams():
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"

    def entries(data):
        out = pa.BufferOutputStream()
        return [(e["offset"], e["record_type"]) for e in warc.rewritten(memoryview(data), out, "f")]

    whole = gzip.compress(record * 3)
    assert [k for _, k in entries(whole)] == ["resource"] * 3
    assert [k for _, k in entries(gzip.compress(record) + gzip.compress(record * 2))] == ["resource"] * 3
    assert [k for _, k in entries(gzip.compress(record * 2 + record[:40]))] == ["resource"] * 2 + ["damaged"]
    assert [k for _, k in entries(gzip.compress(record + b"no record\r\n\r\n"))] == ["resource", "damaged"]
    assert entries(b"") == [] and entries(b"not gzip") == []


def test_archives_of_odd_rows(spark):
    big = "b" * 2000
    rows = [(None, "u", big), (None, "u", big), (None, None, None), (5, "u", "c" * 1000), (5, "u", "c" * 1000), (4, "u", "c" * 1000), (None, "u", "c" * 1000)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as payload", "2 as record", "3 as size", "4 as top")
    _, folder, count = archived(spark, df)
    assert count == 7
    read = warc.read_records(warc.read_index(spark, folder), folder).select(warc.page_of(warc.F.col("record_id")).alias("p"), "record_type", "refers_to")
    got = sorted((r.p is None, r.p or 0, r.record_type, r.refers_to or "") for r in read.collect())
    top = "<urn:webframe:page:5>"
    assert got == [(False, 4, "revisit", top), (False, 5, "response", ""), (False, 5, "response", ""), *[(True, 0, "response", "")] * 3, (True, 0, "revisit", top)]
    _, folder, count = archived(spark, spark.createDataFrame([], PAGES))
    assert count == 0 and warc.read_records(warc.read_index(spark, folder), folder).count() == 0


ARTICLE = "<p>First, a sentence of the article; it has some length.</p><p>Second one, with a comma.</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>a <b>bo</b>ld\n\n word.<br>Next</article><footer>f</footer>", "Title a bold word. Next"),
        ("<article><p>x<script>var t='</p>';</script>y</p><aside>no</aside><form>no<input></form><style>p{}</style>", "xy"),
        ("<article><p>A &lt;b&gt; &#38; &#x26; &#0000000000000000038; &copy; &nosuch;</p>", "A <b> & & & © &nosuch;"),
        ("<main><div class='cookie-notice'>We use</div><p>Text.</p><div id=comments>Nice!</div></main>", "Text."),
        ("<article><p>one<!-- no <p>no --><p>two</article><div class=ad>no</div>", "one two"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
        ("<article>a < b <3 </ c></x> d</article>", "a < b <3 d"),
        ("<article><p title='a>b'>kept</p><p hidden>no</p><p style=\"display: none\">no</p></article>", "kept"),
        ("<article><p>foo <span class=ad><div>no</div></span>bar</p></article>", "foo bar"),
        ("<article><p>x</p><!-- never closed <p>no", "x"),
        ("<article></article>", ""),
        (f"<div id=top><a href=a>Home</a><a href=b>News</a></div><div id=x>{ARTICLE}</div><div>ok</div>", "First, a sentence of the article; it has some length. Second one, with a comma."),
    ],
)
def test_main_text(page, want):
    assert html_paths.main_text(page) == want


def test_body_in_divs_beside_article_cards():
    body = [f"Paragraph {i} of the story, which is told at length; it has commas, stops and many more words than a card." for i in range(8)]
    cards = "".join(f"<article><a href=/{i}>Other story {i}</a></article>" for i in range(4))
    text = html_paths.main_text("<div><div class=text>" + "".join(f"<p>{t}</p>" for t in body) + f"</div><div>{cards}</div></div>")
    assert all(t in text for t in body)


def test_ratios_decide_beside_an_article():
    page = f"<div><a href=a>Home</a> <a href=b>All the news</a></div><article>{ARTICLE * 3}</article><div>Top</div>"
    assert html_paths.main_text(page) == " ".join(["First, a sentence of the article; it has some length. Second one, with a comma."] * 3)


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content-sidebar-wrap'><main>{}</main></div>",
        "<div id='page' class='has-sidebar'>{}</div>",
        "<article class='post no-sidebar'>{}</article>",
        "<div class='elementor-widget elementor-widget-text'>{}</div>",
        "<div class='widget'>{}</div>",
        "<div class=sidebar><article>{}</article></div>",
        "<div class=widget>{0}</div><div class=widget>{0}</div><div class=widget>{0}</div>",
        "<article><div title='the hidden cost' data-x='display:none'>{}</div></article>",
        "<main>{}</main><div class='site-footer'>Imprint.</div><div id=primary-sidebar-2>Recent.</div>",
    ],
)
def test_names_are_hints(page):
    text = "First, a sentence of the article; it has some length. Second one, with a comma."
    assert html_paths.main_text(page.format(ARTICLE)) == " ".join([text] * page.count("{0}") or [text])


STORY = [f"Paragraph {i} of the story, which is told at length; it has commas, stops and many more words than a menu." for i in range(8)]
MENU = "<div class=bar><ul>" + "".join(f"<li><a href=/{i}>Section {i}</a>" for i in range(30)) + "</ul></div>"


def _list(n):
    return "<ul>" + "".join(f"<li>item {i}</li>" for i in range(n)) + "</ul>", [f"item {i}" for i in range(n)]


def _table(n):
    return "<table>" + "".join(f"<tr><th>row {i}<td>{i * 7}" for i in range(n)) + "</table>", [x for i in range(n) for x in (f"row {i}", str(i * 7))]


def _terms(n):
    return "<dl>" + "".join(f"<dt>term {i}<dd>meaning {i}" for i in range(n)) + "</dl>", [x for i in range(n) for x in (f"term {i}", f"meaning {i}")]


@pytest.mark.parametrize("box", ["article", "main", "div", "section"])
@pytest.mark.parametrize("make", [_list, _table, _terms])
@pytest.mark.parametrize("n", [1, 5, 10, 60, 400])
@pytest.mark.parametrize("at", [0, 4, 8])
def test_lists_and_tables_of_an_article_stay(box, make, n, at):
    source, items = make(n)
    parts = [f"<p>{t}</p>" for t in STORY]
    parts.insert(at, source)
    page = f"{MENU}<{box}><h1>Title</h1>{''.join(parts)}<h2>End</h2></{box}>{MENU}"
    assert html_paths.main_text(page) == " ".join(["Title", *STORY[:at], *items, *STORY[at:], "End"])


def test_pages_of_lists_only():
    for make in (_list, _table, _terms):
        source, items = make(40)
        assert html_paths.main_text(f"{MENU}<div>{source}</div>") == " ".join(items)


def test_layout_table_loses_its_menu_cell():
    cells = "".join(f"<p>{t}</p>" for t in STORY)
    page = f"<table><tr><td><a href=a>Home</a> <a href=b>News</a></td><td>{cells}</td></tr></table>"
    assert html_paths.main_text(page) == " ".join(STORY)


def plain_text(blocks):
    """The method spelt out for flat pages: blocks are (path, box, text, linked); nothing is named or declared."""
    paths = sorted({b[0] for b in blocks})
    ratios = {}
    for p in paths:
        mine = [b for b in blocks if b[0] == p]
        chars = sum(len(t) - k for _, _, t, k in mine)
        marks = sum(sum(c in ".,;:!?" for c in t) for _, _, t, k in mine if k < len(t))
        ratios[p] = ((1 + chars) / len(mine), (1 + marks) / len(mine))
    fused = {p: [] for p in paths}
    for i, (p, *_) in enumerate(blocks):
        near = [ratios[q[0]] for q in blocks[max(0, i - 1) : i + 2]]
        a, b = ((ratios[p][j] + sum(x[j] for x in near) / len(near)) / 2 for j in (0, 1))
        fused[p].append((a * b) ** 0.5)
    score = {p: sum(v) / len(v) for p, v in fused.items()}
    mean = sum(score[p] * len(t) for p, _, t, _ in blocks) / max(1, sum(len(t) for _, _, t, _ in blocks))
    good = [score[p] >= mean / 2 and 2 * k <= len(t) for p, _, t, k in blocks]
    weight = {b[1]: sum((len(t) - k) * (1 if g else -1) for (_, x, t, k), g in zip(blocks, good) if x == b[1]) for b in blocks}
    return " ".join(t for (_, x, t, k), g in zip(blocks, good) if g or (weight[x] >= 0 and 2 * k < len(t)))


def test_ratios_equal_the_plain_method():
    rng = random.Random(5)
    for _ in range(300):
        page, blocks = "", []
        for box in range(rng.randint(1, 6)):
            outer = rng.choice(["div", "section", "div><section", "center"])
            page += f"<{outer}>"
            for _ in range(rng.randint(1, 5)):
                tag = rng.choice(["p", "h2", "pre", "blockquote"])
                text = " ".join(rng.choice(["word", "other,", "end.", "long-word"]) for _ in range(rng.choice([1, 3, 40])))
                linked = rng.random() < 0.3
                page += f"<{tag}>" + (f"<a href=x>{text}</a>" if linked else text) + f"</{tag}>"
                blocks.append((f"{outer}/{tag}", box, text, len(text) if linked else 0))
            page += "".join(f"</{t}>" for t in reversed(outer.split("><")))
        assert html_paths.main_text(page) == plain_text(blocks), page


def test_deep_broken_and_long_pages():
    assert html_paths.main_text("<article>" + "<div>" * 20_000 + "deep") == "deep"
    assert html_paths.main_text("<article>" + "<b>" * 20_000 + "deep" + "</i>" * 20_000) == "deep"
    assert html_paths.main_text("<article>" + "word " * 200_000) == " ".join(["word"] * 200_000)
    html_paths.main_text("<" * 100_000 + "<a x=\"" * 2_000 + "&#" + "9" * 10_000 + ";")


def test_extract_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None), (1, "u", "<p>x"), (1, "u", "<p>x")], PAGES).selectExpr("*", "1 as text", "2 as row")
    assert [tuple(r) for r in html_paths.extract(df).orderBy("page_id").collect()] == [(None, None, ""), (1, "u", "x"), (1, "u", "x")]
    assert html_paths.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_articles_of_the_table(spark):
    """The table's pages have one article each: its text without tags is the main text."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_paths.extract(pages).collect()}
    for r in pages.collect():
        body = re.split("</article>|<footer>", r.html.split("<article>", 1)[1])[0]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", body)).split())
