"""Quality rules whose cutoffs come from the data: quantile sketches per language and source.

Every text gives counts (words, symbols, repeated lines and words) in one pass of native expressions.
Of those, rates in parts per 10 000 go into a sketch per language, source and rate: a histogram over
buckets of about 3 % relative width, so sketches are merged by adding counts, in any order, with the
same result. The upper fence of a rate is its third quartile plus `spread` interquartile ranges, but
at least `slack` above that quartile; a text beyond a fence of its own language and source is
rejected. Groups of under `least` texts use the merged sketch of all groups.

Null texts count as empty; null languages and sources are groups of their own. A text without words
fails the base rules. Only the id, text, language and source are read; other columns may have any name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webframe.llm.shared import let, stored

#: Fixed values of the rules: white space, and the characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
RATES = ("symbol_rate", "line_rate", "repeat_rate", "bang_rate", "length_rate")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: Column) -> Column:
    """Words in 3-word windows found twice or more. The windows are sorted by hash, so equal ones meet."""

    def covered(hashes: Column) -> Column:
        windows = F.slice(
            F.transform(hashes, lambda x, i: F.struct(F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("p"))),
            1,
            F.greatest(F.size(hashes) - 2, F.lit(0)),
        )

        def twice(by_hash: Column) -> Column:
            same = F.filter(
                by_hash,
                lambda e, i: (e["h"] == F.get(by_hash, i - 1)["h"]) | (e["h"] == F.get(by_hash, i + 1)["h"]),
            )
            starts = F.transform(same, lambda e: e["p"])
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

        return let(F.sort_array(windows), twice)

    return let(F.transform(words, lambda x: F.xxhash64(x)), covered)


def with_counts(docs: DataFrame, text: str = "_text") -> DataFrame:
    """Add the counts, and n_lines and n_bangs, to docs, which has no column of those names."""
    t = F.col(text)

    def counted(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeated(words).cast("long").alias("n_repeat_words"),
        )

    def lined(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda s: F.ltrim(F.translate(s, "\t\x0b\x0c\r", "    ")) != "")
    symbols = F.char_length(F.regexp_replace(t, SYMBOLS, "")).cast("long")
    bangs = F.char_length(F.regexp_replace(t, "[^!]+", "")).cast("long")
    made = docs.withColumns({"_w": let(words, counted), "_l": let(lines, lined), "n_symbols": symbols, "n_bangs": bangs})
    names = [F.col(f"`{c}`") for c in docs.columns]
    return made.select(*names, "_w.*", "_l.*", "n_symbols", "n_bangs")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _rates() -> dict[str, Column]:
    """Whole numbers, so that they are the same in every engine and order."""

    def per(a: str, b: str) -> Column:
        return F.expr(f"coalesce({a} * 10000 div nullif({b}, 0), 0)")

    return {
        "symbol_rate": per("n_symbols", "word_chars"),
        "line_rate": per("n_dup_lines", "n_lines"),
        "repeat_rate": per("n_repeat_words", "n_words"),
        "bang_rate": per("n_bangs", "n_words"),
        "length_rate": F.expr("coalesce(word_chars * 100 div nullif(n_words, 0), 0)"),
    }


def bucket_floor(value: Column) -> Column:
    """The smallest value of the bucket: the value with all but its six leading binary digits cleared."""

    def cleared(digits: Column) -> Column:
        return F.call_function("shiftleft", F.call_function("shiftright", value, digits), digits)

    return let(F.greatest(F.length(F.bin(value)) - 6, F.lit(0)), cleared)


def sketches(rated: DataFrame) -> DataFrame:
    """lang, source, rate, bucket, n: counts by bucket. Sketches of two tables merge by adding n."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bucket_floor(F.col(r)).alias("bucket")) for r in RATES]))
    flat = rated.select(F.col("_lang"), F.col("_source"), each.alias("e"))
    return flat.groupBy("_lang", "_source", "e.rate", "e.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, spread: float, slack: dict[str, int], least: int) -> DataFrame:
    """One row per language and source: the upper fence of each rate, as a column of its name.

    Windows run over the buckets of one sketch, whose number is bounded by their width."""

    def quartiles(by: list[str]) -> DataFrame:
        counts = sketch.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))
        one = Window.partitionBy(*by, "rate")
        run = counts.withColumns({"upto": F.sum("n").over(one.orderBy("bucket")), "total": F.sum("n").over(one)})
        low = F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bucket")))
        high = F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bucket")))
        got = run.groupBy(*by, "rate").agg(low.alias("q1"), high.alias("q3"), F.max("total").alias("total"))
        margin = F.greatest(F.lit(spread) * (F.col("q3") - F.col("q1")), F.create_map(*[F.lit(x) for kv in slack.items() for x in kv])[F.col("rate")])
        return got.select(*by, "rate", "total", (F.col("q3") + margin).cast("long").alias("fence"))

    own = quartiles(["_lang", "_source"])
    whole = quartiles([]).select("rate", F.col("fence").alias("whole"))
    chosen = own.join(whole, "rate").withColumn("fence", F.when(F.col("total") >= least, F.col("fence")).otherwise(F.col("whole")))
    wide = [F.max(F.when(F.col("rate") == r, F.col("fence"))).alias(f"_{r}") for r in RATES]
    return chosen.groupBy("_lang", "_source").agg(*wide)


#: How far above the third quartile a rate may always lie: in parts per 10 000, for length_rate in hundredths of a character.
SLACK = {"symbol_rate": 300, "line_rate": 5000, "repeat_rate": 4000, "bang_rate": 1000, "length_rate": 400}


def judged(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    spread: float = 3.0,
    slack: dict[str, int] = SLACK,
    least: int = 100,
    carry: list[str] | None = None,
) -> DataFrame:
    """docs (or the columns of them in `carry`) as a struct column `row`, with the counts, base_failed, kept and the rates.

    The rows with their counts are written once, and read for the sketches and for the verdicts; no
    text is shuffled. The fences are read from a file too, so that Spark broadcasts them by their size."""
    names = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row")
    rows = docs.select(
        names, F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(lang).alias("_lang"), F.col(source).alias("_source")
    )
    rated = stored(with_counts(rows).drop("_text").withColumns(_rates()), "quality-counts")
    limits = fences(sketches(rated), spread, slack, least)
    limits = stored(limits.withColumnsRenamed({"_lang": "f_lang", "_source": "f_source"}), "quality-fences")
    same = F.col("_lang").eqNullSafe(F.col("f_lang")) & F.col("_source").eqNullSafe(F.col("f_source"))
    within = F.lit(True)
    for r in RATES:
        within = within & (F.col(r) <= F.col(f"_{r}"))
    marked = rated.join(limits, same, "left").withColumn("base_failed", base_failed())
    return marked.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True))).select(
        "row", *COUNTS, "base_failed", "kept", *RATES
    )
