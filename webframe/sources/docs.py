"""The page store: shape, read, write, first-wins and latest-wins merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webframe import schemas
from webframe.functions import url as U

DOMAIN_BUCKETS = 256


def _bucket(domain):
    return F.pmod(F.xxhash64(domain), F.lit(DOMAIN_BUCKETS)).cast("int")


def batch_folder(path: str, batch: int) -> str:
    """Where a batch of a store's pages lies."""
    return f"{path}/batch={batch}"


def read_docs(spark: SparkSession, path: str, domain: str | None = None) -> DataFrame:
    """Stored pages; with `domain`, only its folders are read."""
    docs = spark.read.schema(schemas.DOCS + ", batch int, domain_bucket int").parquet(path)
    if domain is not None:
        docs = docs.filter((F.col("domain_bucket") == _bucket(F.lit(domain))) & (F.col("domain") == domain))
    return docs.drop("batch", "domain_bucket")


def write_docs(docs: DataFrame, path: str, mode: str = "append", batch: int = 0) -> None:
    """Write pages in folders by a hash of the domain. The rebalance keeps files few and splits
    the folder of a very large domain over many tasks. A writer that may have to write again gives its batch a number, which
    has a folder of its own, and overwrites it."""
    rows = docs.withColumn("domain_bucket", _bucket(F.col("domain"))).hint("rebalance", "domain_bucket")
    rows.write.mode(mode).partitionBy("domain_bucket").parquet(batch_folder(path, batch))


def stored_urls(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """The urls of a store, or of one of its batches."""
    folder = path if batch is None else batch_folder(path, batch)
    return spark.read.schema(schemas.SEEN).parquet(folder).select("url").distinct()


def to_docs(responses: DataFrame) -> DataFrame:
    """Stored form of decoded responses with links; rows without a response are dropped."""
    return responses.filter(F.col("code").isNotNull()).select(
        "url",
        U.host(F.col("url")).alias("domain"),
        "code",
        F.col("content").alias("body"),
        "links",
        "headers",
        "content_type",
        "crawl_time",
    )


def _one_version(docs: DataFrame, newest: bool) -> DataFrame:
    """One row per url. row_number() = 1 lets Spark keep one row per url and task before the
    shuffle, so many copies of a url never meet in one task."""
    time = F.col("crawl_time").desc_nulls_last() if newest else F.col("crawl_time").asc_nulls_last()
    # ties in time are settled by code and text, so results do not vary by run
    ties = [F.col("code").asc(), F.xxhash64("body").asc()]
    order = Window.partitionBy("url").orderBy(time, *ties)
    return docs.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def latest_versions(docs: DataFrame) -> DataFrame:
    """The last version of each url in a store to which all versions are appended."""
    return _one_version(docs, newest=True)


def append_first_wins(existing: DataFrame, new: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """The rows of `new` to append: first version of each url that is not stored yet.

    Of the store only the urls are read, and only those that come again (`urls`, by default those of `new`)
    are joined with the new pages. Where Spark knows that `urls` is small, as for a table that
    `session.written` gives, it broadcasts them, and no stored url is moved."""
    came = (new if urls is None else urls).select("url").distinct()
    again = existing.select("url").join(came, "url", "left_semi")
    return _one_version(new.join(again, "url", "left_anti"), newest=False)


def upsert_latest(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The store after `new` was put: last version of each url.

    Urls that do not come again pass through without their bodies being sorted or compared."""
    fresh = new.select("url").distinct()
    again = existing.join(fresh, "url", "left_semi")
    changed = _one_version(again.unionByName(new), newest=True)
    return existing.join(fresh, "url", "left_anti").unionByName(changed)


def need_fetch(frontier: DataFrame, docs: DataFrame, enabled: bool = False) -> DataFrame:
    """Urls to fetch. Off by default, then all; enabled, stored urls go unless forced."""
    if not enabled:
        return frontier
    stored = docs.select(F.col("url").alias("_stored"))
    forced = F.coalesce(F.col("force"), F.lit(False))
    return frontier.join(stored, (F.col("url") == F.col("_stored")) & ~forced, "left_anti")


def replay_responses(batch: DataFrame, archive: DataFrame) -> DataFrame:
    """Attach the newest archived response to each planned url; without one the response is null.

    The archive is first cut down to the batch's urls. A batch is small beside it: where Spark knows its size (it
    was read from files, as `session.written` gives it) and finds it small, it broadcasts those urls, and
    the archive is read in place; only its matches are sorted and moved."""
    wanted = archive.join(batch.select("url").distinct(), "url", "left_semi")
    return batch.join(_one_version(wanted, newest=True), "url", "left")
