"""Near copies by word shingles: five words, a Jaccard similarity of 0.8 or more.

A text's fingerprint is a SimHash of BITS bits over its distinct shingles. Texts as similar as that differ in
about 78 of 512 bits, too many for whole blocks to agree, so candidates share one of KEYS keys instead, each of
KEY_BITS sampled bits of the first KEYED, and differ in at most DISTANCE bits, two and a half standard deviations more. Every candidate pair is then verified by the
exact similarity of its shingle sets before it is a link; components of the links are found as in `simhash`.

The keys are taken in rounds of growing size (ROUNDS). What a round has joined is one cluster for the next, which only looks for
pairs between different clusters that no round has tested: texts of a large family mostly meet in the first round, and their many keys do not all give
pairs anew. Within a key all close pairs between clusters are candidates. Only where a group has more than FEW of them per member
they are thinned to a minimum spanning forest, whose edges join clusters whether they turn out to be links or not.

So a cluster holds every pair that was thinned away. After the rounds each cluster whose verified links do not reach all of it is compared
exactly: every text outside its largest part with every text of other parts, by their whole shingle sets, inside tasks over pairs of tiles of
bounded size (`exact_links`). Only links that join parts leave a task. A key with more than
`tile` texts is dealt over several tiles, each pair of tiles a group of its own.

Texts with the same words are one node, which is how null and empty texts are linked; so are repeated rows and ids. A null id is
the smallest of its component only where no row of it has an id. Only the id and the text are read, whatever other columns are called."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.llm.shared import blocks_of, shuffle_partitions, stored, worker_state
from webframe.llm.simhash import SEED, components

WIDTH = 5
BITS, KEYED, KEY_BITS, KEYS = 512, 128, 16, 96
DISTANCE = 98
#: Candidates per member of a group before they are thinned; groups of up to SMALL members are never thinned.
FEW, SMALL = 8, 32
#: The keys of each round, from one number up to the next.
ROUNDS = (0, 12, 36, 66, KEYS)
#: Shingles of a tile in exact comparisons; a tile holds one text at least.
TILE_GRAMS = 1 << 21


def _places() -> np.ndarray:
    """The bits of each key: rounds of a shuffle of all bits, cut into disjoint keys."""
    rng = np.random.default_rng(SEED)
    rounds = [rng.permutation(KEYED).reshape(-1, KEY_BITS) for _ in range(KEYS * KEY_BITS // KEYED)]
    return np.concatenate(rounds)


def words_line(text: str | None) -> tuple[bytes, list[bytes]]:
    words = (text or "").encode().lower().split()
    return b" ".join(words), words


def grams(line: bytes, words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Distinct shingles as rows of two 64-bit hashes, in order."""
    import xxhash

    if not words:
        return np.zeros((0, 2), np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[len(words) - n :].tolist()
    digest = xxhash.xxh3_128_digest
    found = {digest(line[a:b], SEED) for a, b in zip(starts, stops)}
    return np.frombuffer(b"".join(sorted(found)), np.uint64).reshape(-1, 2)


def node_and_grams(text: str | None) -> tuple[int, np.ndarray]:
    """The number of a text's node, signed, and its shingles."""
    import xxhash

    line, words = words_line(text)
    number = xxhash.xxh3_64_intdigest(line, SEED)
    return number - (1 << 64) if number >> 63 else number, grams(line, words)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number: multiply, shift, xor."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint, as unsigned 64-bit numbers: the shingles' own two hashes, and more made from the first."""
    ones = np.zeros(BITS, np.int64)
    more = np.arange(1, BITS // 64 - 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at : at + (1 << 12)]
        wide = np.concatenate([part, _mixed(part[:, :1] + more)], axis=1)
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def marks_of(column: pa.Array) -> np.ndarray:
    """Fingerprints, a row each, of a column of them without nulls."""
    if not len(column):
        return np.zeros((0, BITS // 64), np.uint64)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint64, len(column) * BITS // 64, at).reshape(-1, BITS // 64)


def keys_of(marks: np.ndarray) -> np.ndarray:
    """KEYS keys for each fingerprint: the key's number and its bits."""
    bits = np.unpackbits(np.ascontiguousarray(marks[:, : KEYED // 64]).view(np.uint8), axis=1, bitorder="little")
    packed = np.packbits(bits[:, _places().ravel()].reshape(-1, KEY_BITS), axis=1).astype(np.int64)
    return (packed[:, 0] << 8 | packed[:, 1]).reshape(-1, KEYS) | np.arange(KEYS) << KEY_BITS


NODE = ["node", "root", "mark"]


def _sketched(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        worker_state("near_copies")  # what the worker holds of other operators goes
        for part in blocks_of(batches, "text", 4 << 20):
            node, marks, sizes = [], [], []
            for text in part.column("text"):  # one text's words and shingles at a time
                number, found = node_and_grams(text.as_py())
                node.append(number)
                marks.append(sketch(found).tobytes())
                sizes.append(len(found))
            columns = [pa.array(node, pa.int64()), pa.array(marks, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "node", "mark", "size"])

    return rows.mapInArrow(run, "doc_id long, node long, mark binary, size long")


def _keyed(points: DataFrame, first: int, last: int) -> DataFrame:
    """key, node, root, mark: a row per key, of those from `first` to before `last`, of every point."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = keys_of(marks_of(part.column("mark")))[:, first:last].ravel()
                each = pa.array(np.repeat(np.arange(part.num_rows), last - first))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(part.column(c).take(each) for c in NODE)], ["key", *NODE])

    return points.select(*NODE).mapInArrow(run, "key long, node long, root long, mark binary")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def forest(marks: np.ndarray, distance: int, roots: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A minimum spanning forest of all links of at most `distance` bits, as pairs of positions. Those of one root are linked already
    and their pairs not given."""
    roots = np.arange(len(marks)) if roots is None else roots
    n = len(marks)
    best, by = np.full(n, BITS + 1), np.zeros(n, np.int64)
    waiting, links, at = np.arange(1, n), [], 0
    while len(waiting):
        new = np.where(roots[waiting] == roots[at], 0, apart(marks[waiting], marks[at]))
        closer = new < best[waiting]
        best[waiting[closer]], by[waiting[closer]] = new[closer], at
        k = int(np.argmin(best[waiting]))
        at = int(waiting[k])
        waiting = np.delete(waiting, k)
        if best[at] <= distance and roots[by[at]] != roots[at]:
            links.append((int(by[at]), at))
    return links


def group_pairs(marks: np.ndarray, roots: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, bool]:
    """Candidate pairs of a group between different roots, as positions: all close ones, or a forest where these are many.
    The second result says that it is a forest."""
    n = len(marks)
    if (roots == roots[0]).all():
        return np.zeros((0, 2), np.int64), False
    found, total = [], 0
    for at in range(0, n, 256):
        close = apart(marks[at : at + 256, None], marks[None, at:]) <= distance
        a, b = np.nonzero(close & (roots[at : at + 256, None] != roots[None, at:]))
        found.append(np.stack([a, b], axis=1)[a < b] + at)
        total += len(found[-1])
        if n > SMALL and total > FEW * n:
            return np.array(forest(marks, distance, roots), np.int64).reshape(-1, 2), True
    return np.concatenate(found), False


def _candidates(points: DataFrame, distance: int, tile: int, first: int, last: int) -> DataFrame:
    """a, b, thinned: pairs of nodes of different roots to verify, and whether they stand for others."""
    keyed = _keyed(points, first, last)
    hot = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile), "large-keys")
    tiles = F.coalesce(F.ceil(F.col("n") / F.lit(tile)), F.lit(1)).cast("int")
    tiled = keyed.join(hot, "key", "left").withColumn("tiles", tiles)
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    group = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group")
    dealt = tiled.select("key", *NODE, "own", other).select(group, *NODE)
    dealt = dealt.repartition(shuffle_partitions(points.sparkSession), "group").sortWithinPartitions("group", "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("thinned", pa.bool_())])

    def pairs(group: np.ndarray, node: np.ndarray, root: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        a, b, thin = [], [], []
        small = np.repeat(sizes <= SMALL, sizes)
        for shift in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
            at = np.flatnonzero((group[shift:] == group[:-shift]) & small[shift:] & (root[shift:] != root[:-shift]))
            at = at[apart(marks[at], marks[at + shift]) <= distance]
            a.append(node[at])
            b.append(node[at + shift])
            thin.append(np.zeros(len(at), np.int64))
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            got, thinned = group_pairs(marks[s : s + n], root[s : s + n], distance)
            a.append(node[got[:, 0] + s])
            b.append(node[got[:, 1] + s])
            thin.append(np.full(len(got), int(thinned)))
        rows = np.stack([np.concatenate(x) for x in (a, b, thin)], axis=1) if a else np.zeros((0, 3), np.int64)
        low, high, flag = np.unique(rows, axis=0).T
        return pa.RecordBatch.from_arrays([pa.array(low.copy()), pa.array(high.copy()), pa.array(flag == 1)], schema=schema)

    def run(batches):
        kept = None
        for batch in batches:
            g, v, r = (batch.column(c).to_numpy() for c in ("group", "node", "root"))
            m = marks_of(batch.column("mark"))
            if kept is not None:
                g, v, r, m = (np.concatenate(x) for x in zip(kept, (g, v, r, m)))
            whole = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on in the next batch
            kept = (g[whole:], v[whole:], r[whole:], m[whole:])
            if whole:
                yield pairs(g[:whole], v[:whole], r[:whole], m[:whole])
        if kept is not None and len(kept[0]):
            yield pairs(*kept)

    found = dealt.mapInArrow(run, "a long, b long, thinned boolean")
    return found.groupBy("a", "b").agg(F.bool_or("thinned").alias("thinned"))


def _shingles(nodes: DataFrame, docs: DataFrame, points: DataFrame, doc_id: str, text: str) -> DataFrame:
    """node, grams: the sorted shingle hashes of each of the (distinct) nodes."""
    wanted = nodes.select("node").join(points, "node")
    ids = stored(wanted.select(F.col("first").alias("_id")).distinct(), "candidates")
    rows = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).alias("text"))
    rows = rows.join(ids, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def sets(batches):
        for part in blocks_of(batches, "text", 4 << 20):
            node, hashes = [], []
            for text in part.column("text"):
                number, found = node_and_grams(text.as_py())
                node.append(number)
                hashes.append(np.unique(found[:, 0]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(hashes, pa.binary())], ["node", "grams"])

    return stored(rows.mapInArrow(sets, "node long, grams binary").dropDuplicates(["node"]), "shingles")


def _verified(pairs: DataFrame, docs: DataFrame, points: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """The pairs whose shingle sets have a similarity of `percent` or more."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = _shingles(ends, docs, points, doc_id, text)

    def alike(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = known.select(F.col("node").alias("a"), F.col("grams").alias("left"))
    right = known.select(F.col("node").alias("b"), F.col("grams").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(alike, "a long, b long")


def exact_links(roots: np.ndarray, grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between a row of `left` and one of `right` (masks), as positions: enough of them to join all parts that such links join.
    `grams` are sets of shingle hashes, `roots` say which rows are joined already."""
    sizes = np.array([len(g) for g in grams])
    filled = sizes > 0
    starts = np.cumsum(sizes) - sizes
    codes = np.unique(np.concatenate(grams), return_inverse=True)[1] if filled.any() else np.zeros(0, np.int64)
    held = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    part = np.unique(roots, return_inverse=True)[1]
    links = []
    for i in np.flatnonzero(left & filled):
        apt = 100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])
        other = np.flatnonzero(right & filled & apt & (part != part[i]))
        if not len(other):
            continue
        own = codes[starts[i] : starts[i] + sizes[i]]
        held[own] = True
        if 8 * sizes[other].sum() < len(codes):
            both = np.array([np.count_nonzero(held[codes[starts[j] : starts[j] + sizes[j]]]) for j in other])
        else:
            both = np.zeros(len(sizes), np.int64)
            both[filled] = np.add.reduceat(held[codes], starts[filled], dtype=np.int64)
            both = both[other]
        held[own] = False
        hits = other[100 * both >= percent * (sizes[i] + sizes[other] - both)]
        joined, first = np.unique(part[hits], return_index=True)
        links.extend((int(i), int(j)) for j in hits[first])
        part[np.isin(part, joined)] = part[i]
    return links


def _compared(members: DataFrame, grams: DataFrame, percent: int, tile: int) -> DataFrame:
    """a, b: links within clusters between nodes of different roots. members: node, root, cluster, size.

    The texts of a cluster's largest part are only compared with the others, so a large part with few others is copied once."""
    parts = members.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"))
    order = F.struct("n", "root")
    of = parts.groupBy("cluster").agg(
        F.max(order)["root"].alias("big"), F.max(order)["n"].alias("big_n"), F.max_by("grams", order).alias("big_grams"),
        F.sum("n").alias("n"), F.sum("grams").alias("grams"),
    )

    def tiles(n, grams):
        return F.greatest(F.lit(1), F.ceil(n / F.lit(tile)), F.ceil(grams / F.lit(TILE_GRAMS))).cast("int")

    of = of.select(
        "cluster", "big", tiles(F.col("big_n"), F.col("big_grams")).alias("bigs"),
        tiles(F.col("n") - F.col("big_n"), F.col("grams") - F.col("big_grams")).alias("others"),
    )
    dealt = members.join(stored(of, "clusters"), "cluster").withColumn("is_big", F.col("root") == F.col("big"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("is_big"), F.col("bigs")).otherwise(F.col("others"))).cast("int"))

    def place(left, with_big, right, is_left, is_right):
        return F.struct(
            left.alias("l"), F.lit(with_big).alias("with_big"), right.alias("r"), is_left.alias("is_left"), is_right.alias("is_right")
        )

    yes, no, own = F.lit(True), F.lit(False), F.col("own")
    lefts, rights = F.sequence(F.lit(0), F.col("others") - 1), F.sequence(F.lit(0), F.col("bigs") - 1)
    among = F.transform(lefts, lambda u: place(F.least(own, u), False, F.greatest(own, u), own <= u, own >= u))
    places = F.when(F.col("is_big"), F.transform(lefts, lambda u: place(u, True, own, no, yes)))
    places = places.otherwise(F.concat(among, F.transform(rights, lambda v: place(own, True, v, yes, no))))
    each = dealt.select("cluster", "node", "root", F.explode(places).alias("p"))
    group = F.xxhash64("cluster", "p.l", "p.with_big", "p.r").alias("group")
    each = each.select(group, "node", "root", "p.is_left", "p.is_right").join(grams, "node")
    each = each.repartition(shuffle_partitions(members.sparkSession), "group").sortWithinPartitions("group", "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def found(rows: pa.Table) -> pa.RecordBatch:
        node, root = rows.column("node").to_numpy(), rows.column("root").to_numpy()
        left, right = (rows.column(c).to_numpy() for c in ("is_left", "is_right"))
        sets = [np.frombuffer(g, np.uint64) for g in rows.column("grams").to_pylist()]
        got = np.array(exact_links(root, sets, left, right, percent), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[got[:, 0]]), pa.array(node[got[:, 1]])], schema=schema)

    def run(batches):
        waiting: list[pa.RecordBatch] = []  # rows of one group
        for batch in batches:
            groups = batch.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            for at, upto in zip(cuts, cuts[1:]):
                if waiting and upto > at and waiting[0].column("group")[0].as_py() != groups[at]:
                    yield found(pa.Table.from_batches(waiting))
                    waiting = []
                if upto > at:
                    waiting.append(batch.slice(at, upto - at))
        if waiting:
            yield found(pa.Table.from_batches(waiting))

    return each.mapInArrow(run, "a long, b long")


def _joined(rooted: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """rooted, with the labels of `label` that links (a, b) between nodes join made one."""
    labels = rooted.select("node", label)
    ends = links.join(labels.select(F.col("node").alias("a"), F.col(label).alias("left")), "a")
    ends = ends.join(labels.select(F.col("node").alias("b"), F.col(label).alias("right")), "b")
    found = components(ends.select(F.col("left").alias("a"), F.col("right").alias("b")))
    moved = found.select(F.col("node").alias(label), F.col("root").alias("_new"))
    return stored(rooted.join(moved, label, "left").withColumn(label, F.coalesce("_new", label)).drop("_new"), "rooted")


def near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, distance: int = DISTANCE, tile: int = 2048
) -> DataFrame:
    """doc_id, component_id: the smallest id among documents reachable over links."""
    marked = stored(_sketched(docs, doc_id, text), "sketches")
    points = marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("mark").alias("mark"), F.first("size").alias("size"))
    points = stored(points, "points")
    rooted = points.withColumn("cluster", F.col("node"))
    tested: DataFrame | None = None
    links: DataFrame | None = None
    for at, upto in zip(ROUNDS, ROUNDS[1:]):
        found = stored(_candidates(rooted.withColumn("root", F.col("cluster")), distance, tile, at, upto), "pairs")
        pairs = found.select("a", "b")
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        tested = found.select("a", "b") if tested is None else tested.union(found.select("a", "b"))
        new = stored(_verified(pairs, docs, points, doc_id, text, percent), "verified")
        links = new if links is None else links.union(new)
        rooted = _joined(rooted, new.union(found.filter("thinned").select("a", "b")), "cluster")
    rooted = _joined(rooted.withColumn("root", F.col("node")), links, "root")
    mixed = rooted.groupBy("cluster").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    members = rooted.join(mixed.select("cluster"), "cluster").select("node", "root", "cluster", "size")
    members = stored(members, "members")
    grams = _shingles(members, docs, points, doc_id, text)
    rooted = _joined(rooted, stored(_compared(members, grams, percent, tile), "compared"), "root")
    best = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_node = rooted.join(best, "root").select("node", "component_id")
    return marked.join(by_node, "node").select("doc_id", "component_id")
