"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint has one bit per position, set when over half of its shingle hashes have it.
Fingerprints are split into `blocks` blocks of bits. Two that differ in at most `distance` bits agree in
at least blocks - distance whole blocks, so they share a key for some choice of that many blocks.
Distinct fingerprints, not documents, are joined on these keys and verified by Hamming distance.

Only links that a connected component needs are kept. Within a key, fingerprints are compared in
tiles of bounded size: a key with more than `tile` fingerprints is dealt over several tiles, and each
pair of tiles is a group of its own, so one key may hold any share of the rows. Each group yields a
spanning forest of its close pairs, at most one link per fingerprint. Components are found by rounds
of linking to smaller neighbours, each written to the shared folder.

Null and empty texts have no words and the fingerprint zero, linked like any other. Rows that repeat
an id or a text share their fingerprint and so their component. Only the id and the text are read."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webframe.llm.shared import blocks_of, shuffle_partitions, stored

SEED = 42
BITS = 64


def fingerprint(text: str | None, width: int = 4) -> int:
    """The unsigned fingerprint of a text, as the docstring of the module says."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for part in blocks_of(batches, "text", 4 << 20):
            found = np.array([fingerprint(t, width) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def key_masks(blocks: int, distance: int) -> list[int]:
    """A mask for each choice of blocks - distance blocks."""
    return [sum(c) for c in itertools.combinations(block_masks(blocks), blocks - distance)]


def blocks_for(points: int, distance: int) -> int:
    """The fewest blocks for which a key holds about eight unrelated fingerprints or fewer. Links do not depend on it."""
    blocks = distance + 2
    while (blocks - distance) * BITS / blocks + 3 < math.log2(max(2, points)):
        blocks += 1
    return blocks


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def spanning(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (root, member) that connect the values as all pairs within the distance would.

    Values wait in one array; each that is reached takes its close ones out of it, so a tight group
    empties it quickly."""
    links = []
    waiting = values.view(np.uint64)
    while len(waiting) > 1:
        root = waiting[0]
        queue, waiting = [root], waiting[1:]
        while queue and len(waiting):
            near = np.bitwise_count(waiting ^ queue.pop()) <= distance
            if near.any():
                found = waiting[near]
                waiting = waiting[~near]
                links.extend((int(root), int(x)) for x in found)
                queue.extend(found)
    return links


def close_links(points: DataFrame, blocks: int = 6, distance: int = 4, tile: int = 4096) -> DataFrame:
    """a, b: links between different fingerprints (`fp`, distinct) at most `distance` bits apart, enough of them for
    the connected components of all such links."""
    masks = [_signed(m) for m in key_masks(blocks, distance)]
    each = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "part")
    keyed = points.select("fp", each)
    many = keyed.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tiled = keyed.join(many, ["choice", "part"]).withColumn("tiles", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    pairs = tiled.select("choice", "part", "fp", "own", other.alias("other")).select(
        F.xxhash64("choice", "part", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "fp"
    )
    spark = points.sparkSession
    dealt = pairs.repartition(shuffle_partitions(spark), "group").sortWithinPartitions("group")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(groups: np.ndarray, values: np.ndarray):
        """Links within runs of equal groups: small runs all at once by shifts, large ones one by one."""
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        sizes = np.diff(np.r_[starts, len(groups)])
        a, b = [], []
        small = np.repeat(sizes <= 32, sizes)
        for shift in range(1, int(sizes[sizes <= 32].max(initial=1))):
            same = (groups[shift:] == groups[:-shift]) & small[shift:]
            at = np.flatnonzero(same)
            x, y = values[at], values[at + shift]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= distance
            a.append(x[near])
            b.append(y[near])
        for s, n in zip(starts[sizes > 32], sizes[sizes > 32]):
            got = np.array(spanning(values[s : s + n], distance), np.uint64).reshape(-1, 2).view(np.int64)
            a.append(got[:, 0])
            b.append(got[:, 1])
        return np.concatenate(a) if a else values[:0], np.concatenate(b) if b else values[:0]

    def run(batches):
        kept_g, kept_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            g = np.concatenate([kept_g, batch.column("group").to_numpy()])
            v = np.concatenate([kept_v, batch.column("fp").to_numpy()])
            whole = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on in the next batch
            kept_g, kept_v = g[whole:], v[whole:]
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in linked(g[:whole], v[:whole])], schema=schema)
        if len(kept_g):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in linked(kept_g, kept_v)], schema=schema)

    return dealt.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that can be reached along the links (a, b), for every node of a link.

    Each round turns links so that nodes point to smaller neighbours: a node's larger neighbours, then all
    of them, are linked to the smallest it knows. It ends when a round changes nothing; one row with two
    sums reaches the driver per round. A node's neighbours are never gathered: the smallest is an
    aggregate, joined back to the links."""

    def drawn(edges: DataFrame) -> DataFrame:
        return edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(drawn(links), "links")
    before = mark(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = stored(drawn(large), "links")
        least = edges.groupBy("a").agg(F.min("b").alias("low"))
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = stored(drawn(small.union(least.select("a", F.col("low").alias("b")))), "links")
        now = mark(edges)
        if now == before:
            break
        before = now
    nodes = edges.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.select(F.col("a").alias("node"), "root")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id among documents reachable over links."""
    marked = stored(fingerprints(docs, doc_id, text, width), "fingerprints")
    points = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    points = stored(points, "points")
    blocks = blocks_for(points.count(), distance)
    found = stored(components(close_links(points.select("fp"), blocks, distance)), "components")
    rooted = points.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    best = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_point = rooted.join(best, "root").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(by_point, "fp").select("doc_id", shown, "component_id")
