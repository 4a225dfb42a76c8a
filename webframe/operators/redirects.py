"""Redirect chains followed to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.operators.links import redirect_links
from webframe.session import new_folder, remove_folder
from webframe.sources.docs import latest_versions, replay_responses

MAX_HOPS = 1024


def resolve_redirects(redirects: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """url, target, hops, state for each redirecting url (rows url, redirect).

    `target` is where its chain ends, a url that does not redirect, after `hops` redirects. `state` is 'final', or 'loop'
    where the chain comes round, or 'long' where it has more than `max_hops` redirects or comes round after more than that;
    then target and hops are null. Of several redirects of a url the least counts; rows without one are left out.

    Pointers are doubled: a round joins each open pointer with the pointer of the url that it points to, so a chain of n redirects takes
    log2(n) rounds, whatever its urls' number. Pointers carry the least url that they have passed: two stretches of one length, one
    after the other, have the same only if they share a url, that is, in a loop. Every round is written to the shared folder."""
    spark = redirects.sparkSession
    one = redirects.filter("url IS NOT NULL AND redirect IS NOT NULL").groupBy("url").agg(F.min("redirect").alias("next"))
    rows = one.select("url", "next", F.lit(1).cast("long").alias("hops"), F.col("url").alias("low"), F.lit(True).alias("open"))
    paths: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        paths.append(new_folder(spark, "redirects"))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    def doubled(rows: DataFrame) -> DataFrame:
        """Open pointers that lead on to another pointer's end; those that do not are closed."""
        on = rows.select(
            F.col("url").alias("next"), F.col("next").alias("_next"), F.col("hops").alias("_hops"), F.col("low").alias("_low"), F.lit(True).alias("_on")
        )
        met = rows.filter("open").join(on, "next", "left")
        moved = met.select(
            "url",
            F.coalesce("_next", "next").alias("next"),
            (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
            F.least("low", F.coalesce("_low", "low")).alias("low"),
            F.col("_on").isNotNull().alias("open"),
        )
        return rows.filter("NOT open").unionByName(moved)

    rows, length = kept(rows), 1
    while length < max_hops and not rows.filter("open").isEmpty():
        rows, length = kept(doubled(rows)), 2 * length
        remove_folder(spark, paths.pop(0))
    # one more look closes chains that have just reached their end, and shows where the least url is passed again
    after = rows.select(F.col("url").alias("next"), F.col("low").alias("_low"), F.col("next").alias("_next"))
    beyond = rows.select(F.col("url").alias("_next"), F.col("low").alias("_low2"))
    ended = rows.join(after, "next", "left").join(beyond, "_next", "left")
    final = F.col("_low").isNull() & (F.col("hops") <= max_hops)
    loop = F.col("_low").isNotNull() & F.col("_low").eqNullSafe(F.col("_low2"))
    return ended.select(
        "url",
        F.when(final, F.col("next")).alias("target"),
        F.when(final, F.col("hops")).alias("hops"),
        F.when(final, "final").when(loop, "loop").otherwise("long").alias("state"),
    )


def replay_followed(batch: DataFrame, archive: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """`replay_responses` for where each url of the batch leads in the archive: adds `final_url`, whose response it is.

    A url whose chain loops or is too long keeps its own response."""
    known = redirect_links(latest_versions(archive)).select("url", "redirect")
    ends = resolve_redirects(known, max_hops).select("url", "target")
    led = batch.join(ends, "url", "left").withColumn("final_url", F.coalesce("target", "url")).drop("target")
    got = replay_responses(led.select(F.col("final_url").alias("url")).distinct(), archive)
    return led.join(got.withColumnRenamed("url", "final_url"), "final_url", "left")
