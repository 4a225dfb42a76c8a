"""Near copies of the pipeline's stage against exact similarities of all pairs."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.conftest import DOCS
from webframe.llm import near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def near_texts(seed=5):
    """Texts with copies in which one to many words are replaced."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    texts = []
    for _ in range(40):
        first = [rng.choice(words) for _ in range(rng.randint(150, 500))]
        texts.append(" ".join(first))
        for share in (0.005, 0.012, 0.02, 0.06):
            copy = list(first)
            for i in rng.sample(range(len(copy)), max(1, round(share * len(copy)))):
                copy[i] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


def test_stage_drops_copies_of_four_fifths(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(near_texts())]
    parent = {r[0]: r[0] for r in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, t, *_ in rows:
        for j, u, *_ in rows[:i]:
            if similarity(t, u) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows, DOCS), "")
    want = {i for i in parent if find(i) == i}
    assert {r.doc_id for r in got.collect()} == want and 40 < len(want) < 120


def test_near_copies_of_odd_rows(odd, none):
    got = Counter((r.doc_id, r.component_id) for r in near_copies.near_copies(odd).collect())
    assert got[(3, 3)] == 2 and got[(4, 3)] == 1 and got[(2, 1)] == 1 and got[(1, 1)] == 2
    assert sum(got.values()) == 10
    assert near_copies.near_copies(none).count() == 0


def test_one_large_group_over_tiles(spark):
    """Copies of one text with one or two words replaced, far more than a tile holds, beside others."""
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 500)}" for _ in range(200)]
    texts = []
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(200), 1 + i % 2):
            copy[at] = f"x{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"y{rng.randint(0, 500)}" for _ in range(200)) for _ in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df, tile=64).collect()}
    assert got == {i: 0 if i < 300 else i for i in range(350)}


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    marks = rng.integers(0, 2**63, (4, 2), dtype=np.uint64)[rng.integers(0, 4, 120)]
    for _ in range(8):
        marks[np.arange(120), rng.integers(0, 2, 120)] ^= np.uint64(1) << rng.integers(0, 64, 120, dtype=np.uint64)
    for distance in (4, 12, near_copies.DISTANCE):
        def parts(links):
            of = list(range(120))
            for a, b in links:
                of = [of[a] if x == of[b] else x for x in of]
            return sorted(Counter(of).values())

        close = [(a, b) for a in range(120) for b in range(a) if near_copies.apart(marks[a], marks[b]) <= distance]
        assert parts(near_copies.forest(marks, distance)) == parts(close)


def family(n, replaced, seed):
    """Texts that differ from one text in `replaced` places each: most pairs are close in bits, few or none are links."""
    rng = random.Random(seed)
    base = [f"w{seed}q{i}" for i in range(300)]
    texts = []
    for i in range(n):
        copy = list(base)
        for at in rng.sample(range(300), replaced[i % len(replaced)]):
            copy[at] = f"x{seed}q{i}"
        texts.append(" ".join(copy))
    return texts


def reached(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j]:
                both = len(sets[i] & sets[j])
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
    return root


def test_no_link_of_a_dense_family_is_lost(spark):
    """Families in which nearly all pairs are candidates and few are links, so that candidates are thinned."""
    texts = family(260, (5, 6, 7), 1) + family(150, (6, 7), 2) + family(60, (1, 7), 3)
    want = reached(texts)
    assert 150 < len(set(want)) < len(texts) - 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tile in (2048, 50):
        got = {r.doc_id: r.component_id for r in near_copies.near_copies(df, tile=tile).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_exact_links_join_what_all_pairs_join():
    rng = np.random.default_rng(4)
    base = np.arange(1, 101, dtype=np.uint64)
    grams = [np.unique(np.r_[base[rng.random(100) < 0.93], rng.integers(10**6, 10**7, 3).astype(np.uint64)]) for _ in range(60)] + [base[:0]]
    everything = np.ones(61, bool)
    root = list(range(61))
    for a, b in near_copies.exact_links(np.arange(61), grams, everything, everything, 80):
        both = len(np.intersect1d(grams[a], grams[b]))
        assert 5 * both >= 4 * (len(grams[a]) + len(grams[b]) - both)
        root = [root[a] if r == root[b] else r for r in root]
    plain = list(range(61))
    for a in range(61):
        for b in range(a):
            both = len(np.intersect1d(grams[a], grams[b]))
            if len(grams[a]) and len(grams[b]) and 5 * both >= 4 * (len(grams[a]) + len(grams[b]) - both):
                plain = [plain[a] if r == plain[b] else r for r in plain]
    assert sorted(Counter(root).values()) == sorted(Counter(plain).values())


def test_sketches_free_the_caches_of_other_operators(spark, frame):
    """A worker that encoded texts before makes sketches without the encoder's words."""
    from webframe.llm import near_copies, packing

    import public_tokenizers

    docs = frame([(i, f"some words of text number {i} and more") for i in range(8)], "doc_id long, text string").coalesce(1)
    packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    marked = near_copies._sketched(docs, "doc_id", "text")
    assert marked.count() == 8

    def held(batches):
        import sys

        import pyarrow as pa

        for batch in batches:
            state = sys.modules.get("_webframe_worker_state")
            encoder = state is not None and hasattr(state, "word_encoder")
            yield pa.RecordBatch.from_arrays([pa.array([encoder] * batch.num_rows)], ["held"])

    assert not any(r.held for r in docs.mapInArrow(held, "held boolean").collect())
