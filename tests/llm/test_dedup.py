"""Exact, SimHash and suffix deduplication against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from webframe.llm import exact_dedup, simhash, suffix_dedup
from webframe.llm.shared import stored


def test_exact_groups(docs, docs_rows):
    same = defaultdict(list)
    for i, t, *_ in docs_rows:
        same[t or ""].append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect()}
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in same.items() for i in g}
    assert got == want


def test_exact_groups_of_odd_rows(odd, none):
    got = Counter(tuple(r)[:4] for r in exact_dedup.exact_groups(odd).collect())
    assert got[(3, 4, 3, False)] == 2 and got[(4, 4, 3, True)] == 1
    assert got[(None, 2, 4, False)] == 1 and got[(1, 2, 4, False)] == 2 and got[(2, 2, 4, True)] == 1
    assert sum(got.values()) == 10
    assert exact_dedup.exact_groups(none).count() == 0


def test_drop_copies_with_maps(spark):
    rows = [(1, "t", {"a": 1}, [{"x": "y"}]), (1, "t", {"b": 0}, None), (0, "t", {"z": 9}, []), (2, None, None, None), (3, "", {}, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, deep array<map<string,string>>")
    got = {tuple(r)[:3] if r.m is None else (r.doc_id, r.text, tuple(r.m.items())) for r in exact_dedup.drop_copies(df).collect()}
    assert got == {(1, "t", (("b", 0),)), (3, "", ())}


def test_drop_copies_keeps_whole_rows(odd, none):
    got = exact_dedup.drop_copies(odd)
    assert got.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in got.collect() if r.doc_id is not None) == [
        (False, -5, "word " * 200), (False, 2, ""), (False, 4, "the same text, told twice over"), (False, 9, "z" * 3000),
    ]
    assert got.count() == 5 and exact_dedup.drop_copies(none).count() == 0


def plain_fingerprint(text, width=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(points, distance):
    """The smallest reachable key of each, by comparing all pairs."""
    parent = {i: i for i in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(points)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if (points[a] ^ points[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in points}


def test_near_duplicates(docs, docs_rows):
    points = {i: plain_fingerprint(t) for i, t, *_ in docs_rows}
    root = roots(points, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{points[i]:016x}", root[i]) for i in points}
    assert any(root[i] != i for i in points)


def test_near_duplicates_of_odd_rows(odd, none):
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert got[(3, 3)] == 2 and got[(4, 3)] == 1 and got[(2, 1)] == 1 and got[(1, 1)] == 2
    assert sum(got.values()) == 10
    assert simhash.near_duplicates(none).count() == 0


def test_every_close_pair_shares_a_key():
    for blocks in (6, 7, 9):
        masks = simhash.key_masks(blocks, 4)
        rng = np.random.default_rng(3)
        for _ in range(300):
            a, change = int(rng.integers(0, 2**63)), sum({1 << int(b) for b in rng.integers(0, 64, 4)})
            assert any((a ^ (a ^ change)) & m == 0 for m in masks)
    assert simhash.blocks_for(10**6, 4) == 6 and simhash.blocks_for(5 * 10**10, 4) > 7


@pytest.mark.parametrize("tile", [8, 4096])
def test_links_of_one_large_group(spark, tile):
    """Fingerprints around one centre, more than fit a tile, and a chain of steps of four bits."""
    rng = np.random.default_rng(1)
    near = {0}
    while len(near) < 150:
        near.add(sum({1 << int(b) for b in rng.integers(0, 63, 3)}))
    chain, x = [], (1 << 62) | (0x5555 << 40)
    for i in range(9):
        x ^= 0xF << (4 * i)
        chain.append(x)
    points = {i: v for i, v in enumerate(sorted(near | set(chain)))}
    by_value = {v: i for i, v in points.items()}
    want = {points[i]: points[r] for i, r in roots(points, 4).items()}
    links = simhash.close_links(spark.createDataFrame([(v,) for v in by_value], "fp long"), tile=tile)
    rows = links.collect()
    assert all((a ^ b).bit_count() <= 4 or want[a] == want[b] for a, b in rows)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert {v: got.get(v, v) for v in want} == want


def plain_removal(rows, length):
    seen, out = {}, {}
    for i, t, *_ in sorted(rows):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        here = {raw[p : p + length] for p in range(len(raw) - length + 1)}
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = [True] * length
        for s in here:
            seen.setdefault(s, i)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block, passes", [(2 << 20, 2), (2000, 1), (500, 3)])
def test_remove_repeats(docs, docs_rows, block, passes):
    got = suffix_dedup.remove_repeats(docs, block=block, passes=passes).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_removal(docs_rows, 50)
    for r in got:
        assert r.n_removed == sum(s.end - s.start for s in r.spans) and r.n_spans == len(r.spans)


def test_remove_repeats_of_odd_rows(spark, odd, none):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(odd).collect())
    assert got[(3, 30, 0)] == 2 and got[(-5, 1000, 0)] == 1 and sum(got.values()) == 10
    assert suffix_dedup.remove_repeats(none).count() == 0
    long = "q" * 10 + "the same passage in all of these documents, again and again"
    rows = [(2, long), (2, long), (1, "other " + long), (None, long), (5, long)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in found.collect()) == [(-1, 69), (1, 0), (2, 69), (2, 69), (5, 69)]


def test_cover_has_every_difference():
    found = {(a - b) % suffix_dedup.MODULUS for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert found == set(range(suffix_dedup.MODULUS))


def test_stored_is_read_again(spark):
    df = stored(spark.range(10), "ten")
    assert sorted(r.id for r in df.collect()) == list(range(10))
