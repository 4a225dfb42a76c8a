"""Links of pages and redirects, and user jobs over stored pages."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.functions import html as H
from webframe.functions import url as U
from webframe.functions.select_html import tree
from webframe.operators.content import with_html
from webframe.functions import text as X
from webframe.session import written


def page_nofollow(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add nofollow: the page asks that none of its links be followed."""
    return pages.withColumn("nofollow", F.coalesce(H.nofollow(H.link_tags(F.col(html))), F.lit(False)))


def extract_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Add links: the http(s) targets of a page's anchors in document order, duplicates kept.

    Empty for pages marked nofollow or without text."""
    tagged = pages.withColumns({"_tags": H.link_tags(F.col(html)), "_base": U.base_parts(F.col(url))})
    found = tagged.withColumn("_hrefs", H.hrefs(F.col("_tags")))
    resolved = F.transform(F.col("_hrefs"), lambda h: U.crawlable(U.resolve(F.col("_base"), h)))
    none = F.array().cast("array<string>")
    links = F.when(~H.nofollow(F.col("_tags")), F.filter(resolved, lambda l: l.isNotNull()))
    return found.withColumn("links", F.coalesce(links, none)).drop("_tags", "_base", "_hrefs")


def redirect_links(responses: DataFrame) -> DataFrame:
    """Add redirect: the target of a 3xx response with a location, else null."""
    location = X.header(F.col("headers"), "location")
    target = F.when(location.contains("://"), location).otherwise(U.resolve(F.col("_base"), location))
    return (
        responses.withColumn("_base", U.base_parts(F.col("url")))
        .withColumn("redirect", F.when(F.col("code").between(300, 399) & (location != ""), target))
        .drop("_base")
    )


def page_links(responses: DataFrame) -> DataFrame:
    """Add links: the redirect target first, then the links in the body."""
    found = extract_links(with_html(redirect_links(responses), "_html"), html="_html")
    first = F.when(F.col("redirect").isNotNull(), F.array("redirect")).otherwise(F.array().cast("array<string>"))
    return found.withColumn("links", F.concat(first, F.col("links"))).drop("_html", "redirect")


def link_edges(docs: DataFrame) -> DataFrame:
    """One row per page, position and link.

    An outer explode, since for an inner one Spark would filter pages by their number of links
    first and find the links twice for that."""
    each = docs.select(F.col("url").alias("src"), F.posexplode_outer("links").alias("pos", "dst"))
    return each.filter(F.col("dst").isNotNull()).select("src", "dst", "pos")


def _attempts(docs: DataFrame, url_regex: str, extract: Callable[[str, str], dict | None], schema: str, body: str) -> DataFrame:
    """The job's rows, with _page and _error null, and a row with these two for each page on which it failed."""
    chosen = docs.filter(F.col("url").rlike(url_regex) & F.col(body).isNotNull())
    chosen = chosen.select("url", F.col(body).alias("body"))
    wanted = docs.sparkSession.createDataFrame([], schema).columns

    def run(batches):
        for pdf in batches:
            rows, failed = [], []
            for url, text in zip(pdf["url"], pdf["body"]):
                try:
                    row = extract(url, text)
                except Exception as e:  # the user's code: whatever it raises concerns this page only
                    failed.append({"_page": url, "_error": f"{type(e).__name__}: {e}"})
                else:
                    if row is not None:
                        rows.append(row)
            if rows:
                yield pd.DataFrame(rows).assign(_page=None, _error=None)
            if failed:
                # a frame of its own, so that the nulls change no column's type
                yield pd.DataFrame(failed).assign(**dict.fromkeys(wanted))

    return chosen.mapInPandas(run, f"{schema}, _page string, _error string")


def map_pages(
    docs: DataFrame,
    url_regex: str,
    extract: Callable[[str, str], dict | None],
    schema: str,
    body: str = "body",
) -> DataFrame:
    """User job over the pages whose url matches: `extract(url, body)` gives a row, or None to skip.

    The url filter runs before Python sees a page, and only two columns are read. A page on which the job raises gives no
    row and does not end the job; `map_pages_failed` shows such pages."""
    return _attempts(docs, url_regex, extract, schema, body).filter("_error IS NULL").drop("_page", "_error")


def map_pages_failed(
    docs: DataFrame,
    url_regex: str,
    extract: Callable[[str, str], dict | None],
    schema: str,
    body: str = "body",
) -> tuple[DataFrame, DataFrame]:
    """The rows of `map_pages`, and url and error of the pages on which the job failed, both from one pass over the pages.

    The pass is written to the shared folder, where both results are read."""
    done = written(_attempts(docs, url_regex, extract, schema, body), "mapped")
    failed = done.filter("_error IS NOT NULL").select(F.col("_page").alias("url"), F.col("_error").alias("error"))
    return done.filter("_error IS NULL").drop("_page", "_error"), failed


def css_extract(container: str, name: str = "h1", urls: str = "li a") -> Callable[[str, str], dict | None]:
    """An `extract` for map_pages: inside `container`, the text of `name` and the hrefs of `urls`."""

    def extract(url: str, body: str) -> dict | None:
        found = tree(body).select(container)
        if not found:
            return None
        names = [n.text() for c in found for n in c.select(name)]
        targets = [n.attrs.get("href") for c in found for n in c.select(urls)]
        return {"url": url, "name": " ".join(names).strip(), "urls": targets}

    return extract


CSS_SCHEMA = "url string, name string, urls array<string>"
