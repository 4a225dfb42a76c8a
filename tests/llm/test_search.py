"""Ranked search, class-based language model and whitening against brute force."""

import glob
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from webframe.llm import class_lm, queries, ranked_search, whitening

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranks(docs, items, k=20):
    texts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in texts]
    n, length = sum(x > 0 for x in sizes), sum(sizes)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        query, found = TERM.findall((text or "").translate(LOWER)), []
        for (i, c), size in zip(texts, sizes):
            score = 0
            for t in query:
                if c[t]:
                    m = 75 + (25 * size * n) // length
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:k])]
    return Counter(out)


ITEMS = [
    (1, "The SAME text, told; twice"), (2, None), (3, ""), (4, "unknownterm"), (5, "word word Word é"), (5, "a b c d e f g h i j"), (None, "some z" + "z" * 2999),
]


@pytest.mark.parametrize("shard,most", [(8192, 200_000), (7, 8)])
def test_ranks_equal_brute_force(spark, docs, docs_rows, odd, none, shard, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("x"))
    words = " ".join(t.split()[3] for _, t, *_ in docs_rows if t and len(t.split()) > 50)
    more = items.unionByName(spark.createDataFrame([(9, words, "y")], items.schema))
    for table, rows, asked in ((docs, docs_rows, more), (odd, [(r.doc_id, r.text) for r in odd.collect()], items)):
        got = ranked_search.ranked(table, asked, shard=shard, most_terms=most)
        want = plain_ranks([r[:2] for r in rows], [(r.item_id, r.text) for r in asked.collect()])
        assert Counter(map(tuple, got.collect())) == want
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search.ranked(none, items).count() == 0
    assert ranked_search.ranked(docs, items.limit(0)).count() == 0


def test_ties_go_by_id_and_equal_scores_all_come_up(spark):
    rows = [(i, "same words here") for i in range(60, 0, -1)] + [(0, "other")]
    got = ranked_search.ranked(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "here other")], "item_id long, text string"), shard=16)
    assert [r.doc_id for r in got.orderBy("rank").collect()] == list(range(20))


def test_best_positions_stop_before_the_lists_end():
    """Many documents, a few of them far better: the bound ends the query early, with the right ones."""
    rng = np.random.default_rng(1)
    n = 4000
    sizes = np.full(n, 3)
    score = rng.integers(1, 1000, 3 * n)
    score[:90] += 5000
    lists = ranked_search.Lists(np.arange(n), sizes, np.tile(np.arange(3), n), score, 3)
    seen = np.zeros(3 * n, bool)
    docs, scores, looked = ranked_search.best_positions(lists, np.arange(3), np.array([1, 2, 1]), 20, 0, seen)
    total = score.reshape(n, 3) @ np.array([1, 2, 1])
    assert looked < n // 4 and not seen.any()
    order = np.lexsort((docs, -scores))[:20]
    assert docs[order].tolist() == np.lexsort((np.arange(n), -total))[:20].tolist() and (scores == total[docs]).all()


def tokens(text):
    return [w.lower() for w in (text or "").encode().split()] + [b""]


def plain_base(rows):
    split = [(i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, tokens(t)) for i, t in rows]
    counts = Counter(w for _, held, ws in split if not held for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [
        (i, held, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6))
        for i, held, ws in split
    ]


BASE = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]


@pytest.mark.parametrize("block", [class_lm.BLOCK, 2000])
def test_base_of_the_language_model_equals_brute_force(docs, docs_rows, odd, none, block):
    for table, rows in ((docs, docs_rows), (odd, odd.collect())):
        out = class_lm.scored(table, rounds=1, block=block)
        got = [(*r[:5], round(r[5], 6)) for r in out.select(*BASE, "base_score").collect()]
        want = plain_base([r[:2] for r in rows])
        assert Counter(r[:5] for r in got) == Counter(r[:5] for r in want)
        assert sorted(r[5] for r in got) == pytest.approx(sorted(r[5] for r in want), abs=1e-5)
        assert all(math.isfinite(r.score) and r.score < 0 for r in out.collect())
    assert class_lm.scored(none).count() == 0


def test_no_training_rows(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    df = spark.createDataFrame([(i, "a b c") for i in held], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens, r.base_score) for r in class_lm.scored(df).collect()} == {(0, 0, 0.0)}


def test_best_classes_equal_a_full_count():
    """The class that a word goes to is the one that makes the likelihood of the whole table greatest."""
    rng = np.random.default_rng(4)
    c = class_lm.CONTEXTS
    row, context, count = [], [], []
    for w in range(30):
        for x in rng.choice(2 * c, 12, replace=False):
            row.append(w)
            context.append(x)
            count.append(rng.integers(1, 9))
    row, context, count = (np.array(x, np.int64) for x in (row, context, count))
    own = rng.integers(0, class_lm.CLASSES, 30)
    table = np.zeros((class_lm.CLASSES, 2 * c), np.int64)
    np.add.at(table, (own[row], context), count)
    got = class_lm.best_classes(row, context, count, own, table)
    for w in range(30):
        values = []
        for k in range(class_lm.CLASSES):
            moved = table.copy()
            on = row == w
            np.add.at(moved, (own[w], context[on]), -count[on])
            np.add.at(moved, (k, context[on]), count[on])
            values.append(class_lm.likelihood(moved))
        assert values[got[w]] == pytest.approx(max(values), abs=1e-6)


def test_transitions_add_up_to_one():
    counts = np.random.default_rng(0).integers(0, 9, (class_lm.STATES, class_lm.STATES))
    counts[:, class_lm.START] = 0
    assert (10 ** class_lm.smoothed(counts)).sum(axis=1) == pytest.approx(1.0)


@pytest.mark.parametrize("piece", [1, 3, 7, 1 << 20])
def test_transitions_in_pieces_equal_those_of_whole_texts(monkeypatch, piece):
    """However many tokens are held at a time, and be a text longer than that."""
    monkeypatch.setattr(class_lm, "PIECE", piece, raising=False)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, class_lm.START, n).astype(np.uint8).tobytes() for n in (1, 5, 1, 9, 40, 2, 1, 6, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["classes"])
    for rows, part in ((texts, batch), (texts[2:7], batch.slice(2, 5)), ([], batch.slice(0, 0))):
        got = [[] for _ in rows]
        for step, starts, at in class_lm._steps(part):
            assert len(step) <= piece
            for k, some in enumerate(np.split(step, starts[1:])):
                got[at + k] += some.tolist()
        want = [[a * class_lm.STATES + b for a, b in zip([class_lm.START, *t], t)] for t in rows]
        assert got == want


def test_blocks_are_read_and_sent_to_python_one_at_a_time(spark, monkeypatch):
    """Spark reads up to 4096 rows of a row group at once, and sends 64 MB: too much for rows of megabytes."""
    groups, sent = [], []
    write, frequent = class_lm.Steps.stored, class_lm.frequent_words

    def look(self, df, name, *a, **k):
        out = write(self, df, name, *a, **k)
        if name == "coded":
            files = [pq.ParquetFile(f) for f in glob.glob(f"{self.paths[id(out)].removeprefix('file:')}/*.parquet")]
            groups.extend(f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups))
        return out

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    def count(blocks, *a):
        sent.extend(r.n for r in blocks.mapInArrow(sizes, "n long").collect())
        return frequent(blocks, *a)

    monkeypatch.setattr(class_lm.Steps, "stored", look)
    monkeypatch.setattr(class_lm, "frequent_words", count)
    rows = [(i, " ".join(f"w{(i * k) % 977}" for k in range(2000))) for i in range(60)]
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    out = class_lm.scored(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rounds=1, block=50_000)
    assert sum(groups) > 10 and set(groups) == {1} and max(sent) <= 2 and sum(sent) == sum(groups)
    assert out.count() == 60 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == size


def test_transitions_of_a_large_batch_take_little_memory():
    """A batch of 4 million tokens: the last step of op12 held some 40 bytes a token, in each of an executor's workers."""
    batch = pa.RecordBatch.from_arrays([pa.array([bytes([1, 2, class_lm.END]) * 400] * 3500, pa.binary())], ["classes"])
    tracemalloc.start()
    try:
        for _ in class_lm._steps(batch):
            pass
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 50 << 20


def test_classes_predict_what_words_alone_do_not(spark):
    """Texts in which a word of one of four kinds is followed by one of the next kind: unseen texts gain by classes."""
    rng = random.Random(3)
    kinds = [[f"{k}{i}" for i in range(60)] for k in "abcd"]
    rows = [(i, " ".join(rng.choice(kinds[(i + j) % 4]) for j in range(100))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = class_lm.scored(df).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    gain = (out[0] - out[1]) / out[2]
    assert gain > 0.4  # of log10(4) = 0.6, had a word's kind been known


def test_registered_language_model_beats_its_base_on_held_out_texts(spark):
    out = queries.QUERIES["op12_class_lm"](spark, SF)
    got = sorted((*r[:5], round(r[5], 6)) for r in out.select(*BASE, "base_score").collect())
    want = sorted(plain_base([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]))
    assert [r[:5] for r in got] == [r[:5] for r in want] and [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=1e-5)
    held = out.filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_registered_whitening_equals_a_dense_solution(spark):
    out = queries.QUERIES["op13_whitening"](spark, SF).toPandas()
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.array(raw.embedding.tolist(), np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    want = y @ v[:, :32] / np.sqrt(e[:32])
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[raw.vec_id].to_numpy()
    got *= np.sign((got * want).sum(axis=0))
    assert np.abs(got - want).max() < 1e-8
    assert out.identity_error.max() < 1e-9 and set(out.n) == {n} and len(out) == 32 * n
    assert out.groupby("component").explained.first().to_numpy() == pytest.approx(e[:32] / e.sum(), rel=1e-9)
    assert dict(zip(out.vec_id, out.deviation)) == dict(zip(raw.vec_id, ((n * x - s) ** 2).sum(axis=1)))


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 0.0]), (1, [1.0, 2.0, 0.0]), (2, None), (3, [None, 1.0, 1.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]),
        (None, [3.0, 1.0, 0.0]), (6, []), (7, [1.0, 2.0]), (8, [-2.0, 0.5, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"n": F.lit("x"), "component": F.lit(None)})
    out = whitening.whitened(df).collect()
    # the third entry never varies, so two directions are left
    assert Counter((r.vec_id, r.component) for r in out) == {(1, 1): 2, (1, 2): 2, (None, 1): 1, (None, 2): 1, (8, 1): 1, (8, 2): 1}
    assert {r.n for r in out} == {4} and out[0].identity_error < 1e-12
    assert whitening.whitened(df.filter("vec_id = 1")).count() == 0  # no variance at all
    assert whitening.whitened(df.limit(0)).count() == 0
    far = spark.createDataFrame([(1, [1e30]), (2, [-1e30]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.deviation for r in whitening.whitened(far).collect()}[1] is None


def test_jacobi_on_close_and_tiny_eigenvalues():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    e = np.r_[np.full(10, 5.0), np.geomspace(1, 1e-6, 28), 0.0, 0.0]
    a = (q * e) @ q.T
    u = whitening.one_sided_jacobi(whitening.pivoted_cholesky((a + a.T) / 2))
    squares = (u * u).sum(axis=0)
    assert squares[:38] == pytest.approx(e[:38], rel=1e-8)
    off = (u.T @ u) - np.diag(squares)
    assert np.abs(off / np.sqrt(np.outer(squares, squares))).max() < 1e-12
