"""Ranked lexical search by the Best Position Algorithm.

Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Texts are read once, for the terms of the
queries only: a document with any becomes a row of term numbers and frequencies. Sums over all documents give N, L and df, from which the
whole-number scores follow.

Those rows are searched where they lie, in shards of `shard` documents. In a shard every query term has an impact list: its
documents by falling score. A query reads its lists on, STEP places at a time, each from its best position, the last up to
which all have been seen; each document that comes up is looked up in all lists at once, and its places there are marked
as seen too. The scores at the best positions bound those of all documents not seen, more tightly than the places last read
do; the query ends when that bound is strictly below the k-th score known so far (so that documents of equal score all come up), which
a task carries on from shard to shard. The best k of each task are then ranked together.

Term sets are sent to the tasks. They are bounded: queries are taken in groups by hash, so many that a group has about
`most_terms` terms or fewer, and each group reads the texts on its own. A single query goes whole, whatever its length.

Null texts have no terms. Rows of equal id are documents of their own, and so are queries; equal rows may both be ranked. A null document id
comes after all others of its score. A query without terms, or without a document of score above 0, has no rows; so has
everything where a table is empty. Repeated terms of a query count as often as they occur. Only ids and texts are read,
whatever other columns are called."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webframe.llm.shared import spent_shuffles, stored

STEP = 64
#: Separators become spaces and A-Z lower case; bytes from 128 on are parts of non-ASCII characters.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
NO_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def forward(docs: DataFrame, known: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """doc_id, n (all terms), term, tf: a row per document with a term; term and tf have those of `known`, ascending."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    numbers = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        get = numbers.value.get
        for batch in batches:
            ids, n, term, tf = [], [], [], []
            for at in range(batch.num_rows):
                all_ = terms(batch.column(1)[at].as_py())
                if not all_:
                    continue
                found = Counter(map(get, all_))
                found.pop(None, None)
                ids.append(batch.column(0)[at].as_py())
                n.append(len(all_))
                own = sorted(found.items())
                term.append([t for t, _ in own])
                tf.append([f for _, f in own])
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "term", "tf"])

    return rows.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


class Lists:
    """The impact lists of a shard.

    doc, score: all lists one after the other, list t from start[t] to start[t + 1], by falling score, then id.
    A document's entries lie at own[of[d]:of[d + 1]], each a place in these lists."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, term: np.ndarray, score: np.ndarray, n_terms: int):
        self.ids = ids
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.lexsort((ids[doc], -score, term))
        self.doc, self.score, self.term = doc[order], score[order], term[order]
        self.start = np.searchsorted(self.term, np.arange(n_terms + 1))
        self.own = np.empty(len(order), np.int64)
        self.own[order] = np.arange(len(order))
        self.of = np.r_[0, np.cumsum(sizes)]

    def places(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Direct access: the document and the place of each of the documents' entries."""
        sizes = self.of[docs + 1] - self.of[docs]
        at = np.repeat(self.of[docs] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        return np.repeat(np.arange(len(docs)), sizes), self.own[at]


def best_positions(lists: Lists, query: np.ndarray, times: np.ndarray, k: int, bar: int, seen: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that may be among the best k, with their scores, and how many documents were looked at.

    `query` has the term numbers and `times` how often each occurs. `bar`: a score that k documents elsewhere reach.
    `seen` is scratch space, a False per entry of the lists, and given back so."""
    n_terms = len(lists.start) - 1
    factor = np.zeros(n_terms, np.int64)
    factor[query] = times
    first, last = lists.start[query], lists.start[query + 1]
    best = first.copy()  # all places before it have been seen, one at least after the first step
    known = np.zeros(len(lists.ids), bool)
    docs, scores, marked = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    top = np.zeros(0, np.int64)
    while True:
        here = [lists.doc[a : min(a + step, b)] for a, b in zip(best, last) if a < b]
        if not here:
            break
        new = np.unique(np.concatenate(here))
        new = new[~known[new]]
        known[new] = True
        row, place = lists.places(new)
        of_query = factor[lists.term[place]] > 0
        row, place = row[of_query], place[of_query]
        seen[place] = True
        marked.append(place)
        # each new document has an entry in one of the lists, and entries lie by document
        total = np.add.reduceat(factor[lists.term[place]] * lists.score[place], np.flatnonzero(np.r_[True, row[1:] != row[:-1]])) if len(row) else new
        docs.append(new)
        scores.append(total)
        top = np.concatenate([top, total])
        if len(top) > k:
            top = np.partition(top, len(top) - k)[len(top) - k :]
        for i, (a, b) in enumerate(zip(best, last)):
            while a < b:
                part = seen[a : min(a + 4 * step, b)]
                gap = int(part.argmin())
                if not part[gap]:
                    a += gap
                    break
                a += len(part)
            best[i] = a
        # what has not been seen comes after the best position in every list, and in none that was seen to its end
        bound = int((lists.score[best - 1] * times)[best < last].sum())
        if bound < max(bar, int(top.min()) if len(top) == k else 0, 1):
            break
    for place in marked:
        seen[place] = False
    return np.concatenate(docs), np.concatenate(scores), int(known.sum())


def _searched(rows: DataFrame, items: list[tuple], weights: np.ndarray, n: int, length: int, k: int, shard: int) -> DataFrame:
    """item, doc_id, score: the best k documents of each task for each query, best first."""
    sent = rows.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches):
        items, weights = sent.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]

        def search(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts).combine_chunks()
            ids = table.column("doc_id").fill_null(NO_ID).to_numpy()
            term, tf = (table.column(c).combine_chunks() for c in ("term", "tf"))
            sizes = np.diff(term.offsets.to_numpy())
            term, tf = term.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy()
            m = 75 + (25 * table.column("n").to_numpy() * n) // length
            score = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, sizes)))
            lists = Lists(ids, sizes, term, score, len(weights))
            seen = np.zeros(len(term), bool)
            for i, (query, times) in enumerate(items):
                old_ids, old = best[i]
                found, scores, _ = best_positions(lists, query, times, k, int(old.min()) if len(old) == k else 0, seen)
                ok = scores > 0
                all_ids, all_scores = np.concatenate([old_ids, lists.ids[found[ok]]]), np.concatenate([old, scores[ok]])
                order = np.lexsort((all_ids, -all_scores))[:k]
                best[i] = all_ids[order], all_scores[order]

        parts, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, shard):
                part = batch.slice(at, min(shard, batch.num_rows - at))
                if size and size + part.num_rows > shard:
                    search(parts)
                    parts, size = [], 0
                parts.append(part)
                size += part.num_rows
        if size:
            search(parts)
        sizes = [len(x[0]) for x in best]
        if sum(sizes):
            ids = np.concatenate([x[0] for x in best])
            columns = [pa.array(np.repeat(np.arange(len(items)), sizes)), pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([x[1] for x in best]))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    shard: int = 8192, most_terms: int = 200_000,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each row of `items`."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    letters = F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")
    groups = asked.select(letters).first()["n"] // (2 * most_terms) + 1  # a term and what parts it take two characters or more
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for group in range(groups):
        chosen = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group).collect()
        found = _ranked_group(docs, [(r["item_id"], Counter(terms(r["text"]))) for r in chosen], k, doc_id, text, shard)
        out = out if found is None else out.unionByName(found)
    return out


def _ranked_group(docs: DataFrame, asked: list[tuple], k: int, doc_id: str, text: str, shard: int) -> DataFrame | None:
    spark = docs.sparkSession
    asked = [(i, c) for i, c in asked if c]
    known = {t: at for at, t in enumerate(sorted({t for _, c in asked for t in c}))}
    if not known:
        return None
    with spent_shuffles(spark):
        rows = stored(forward(docs, known, doc_id, text), "postings")
        sums = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        df = np.zeros(len(known), np.int64)
        for r in rows.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
            df[r["term"]] = r["df"]
        n, length = sums["n"], sums["length"]
        if not n:
            return None
        weights = np.array([weight(int(x), n) for x in df], np.int64)
        items = []
        for _, counts in asked:
            at = np.array(sorted(known[t] for t in counts), np.int64)
            by_number = {known[t]: x for t, x in counts.items()}
            items.append((at, np.array([by_number[x] for x in at.tolist()], np.int64)))
        found = stored(_searched(rows.filter(F.size("term") > 0), items, weights, n, length, k, shard), "best")
    names = spark.createDataFrame([(at, i) for at, (i, _) in enumerate(asked)], "item long, item_id long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranks = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranks.join(names, "item").select("item_id", "rank", "doc_id", "score")
