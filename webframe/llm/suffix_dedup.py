"""Removal of repeated strings by blockwise suffix sorting with a difference cover.

Every byte covered by a string of `length` bytes that also starts in a document with a smaller id goes.
Texts are laid out in blocks of about `block` bytes. Suffixes count to that length, so two are tied
exactly if their first `length` bytes are equal.

1. The cover sample: positions whose distance from the text's start is in a difference cover modulo 21.
   For any two positions some shift under 21 moves both into the sample, so two equal strings of 50 bytes
   hold equal sample strings of 30 bytes at the same place. Samples get ranks (names, equal for equal
   strings), and those whose rank is found once only are settled: most suffixes are never sorted.
2. The other suffixes are dealt into buckets by their key, and the buckets are sorted one at a time, in
   `passes` rounds over the table; a task's memory holds one bucket, the disk one round. A tie on the 64-bit key is
   broken by a further name of 64 bits, of which 32 are kept.
3. A run of ties starts in the document with the smallest id; all others of the run are removed.

A bucket gets each block's distinct keys only, with the smallest id, so a string that fills a third of
all texts is a few bytes per block. It answers with one bit per key, in the order in which it got them,
and the block works out again which positions they stand for. Blocks are kept in a bucketed table, so
texts are shuffled once, for grouping equal ones; a copy of a whole text is removed without sorting. There are
as many buckets as shuffle partitions, and blocks times buckets rows: let `block` grow with the cluster too.

Null texts count as empty. Null ids come after all others; rows that repeat an id never remove each
other. Texts shorter than `length` are kept whole. Only the id and the text are read."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.llm.exact_dedup import content_key
from webframe.llm.shared import shuffle_partitions, spent_shuffles, stored, worker_state

#: A perfect difference set: its differences are all residues modulo 21, once each.
MODULUS = 21
COVER = (3, 6, 7, 12, 14)
LAST = np.iinfo(np.int64).max
NAME_BITS = 48


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hashes:
    """Polynomial hashes of strings in a buffer, from sums over its prefixes. Powers are kept by the worker."""

    def __init__(self, seed: int, data: np.ndarray):
        state = worker_state("suffix_dedup")
        kept = getattr(state, "suffix_powers", {})
        if seed not in kept or len(kept[seed][1]) < len(data):
            rng = np.random.default_rng(seed)
            letters = rng.integers(0, 2**64 - 1, 256, np.uint64)
            factor = int(rng.integers(2**62, 2**63)) | 1
            kept[seed] = letters, _powers(factor, len(data)), _powers(pow(factor, -1, 2**64), len(data))
            state.suffix_powers = kept
        letters, powers, self.back = kept[seed]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * powers[: len(data)], out=self.sums[1:])

    def __call__(self, at: np.ndarray, length: int) -> np.ndarray:
        """The hashes of the strings of `length` bytes at these places."""
        return _mixed((self.sums[at + length] - self.sums[at]) * self.back[at])


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


class Block:
    """Texts of `length` bytes or more, laid out one after the other."""

    def __init__(self, row: dict, length: int):
        self.data = np.frombuffer(row["data"], np.uint8)
        self.ids = np.array(row["ids"], np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.length = length
        self.sample = length - MODULUS + 1
        self.hashes = Hashes(1, self.data)

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the cover sample, and their names."""
        cover = np.isin(np.arange(MODULUS), COVER)
        pattern = np.tile(cover, int(self.sizes.max()) // MODULUS + 1)
        chosen = np.concatenate([pattern[:n] for n in self.sizes.tolist()])
        for end in self.ends.tolist():
            chosen[end - self.sample + 1 : end] = False
        at = np.flatnonzero(chosen)
        return at, self.hashes(at, self.sample) >> np.uint64(64 - NAME_BITS)

    def suffixes(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For suffixes with a live sample within reach: position, document (by place in the block), key, second name."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        edge[np.maximum(live - MODULUS + 1, 0)] += 1  # live positions differ, so do the starts but those cut off at 0
        edge[0] = np.count_nonzero(live < MODULUS)
        edge[live + 1] -= 1
        near = np.cumsum(edge[:-1]) > 0
        for end in self.ends.tolist():
            near[end - self.length + 1 : end] = False
        at = np.flatnonzero(near)
        doc = np.searchsorted(self.ends, at, "right")
        checks = Hashes(2, self.data)(at, self.length) >> np.uint64(32)
        return at, doc, self.hashes(at, self.length), checks.astype(np.uint32)


def _buckets_of(sorted_keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket starts in the keys, which are dealt by range."""
    edges = [-(-(i << bits) // buckets) for i in range(buckets)]
    return np.append(np.searchsorted(sorted_keys, np.array(edges, np.uint64)), len(sorted_keys))


def _pack(names: np.ndarray) -> bytes:
    """Six bytes a name: the high four of all, then the low two."""
    return (names >> np.uint64(16)).astype("<u4").tobytes() + names.astype("<u2").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = len(data) // 6
    high, low = np.frombuffer(data, "<u4", n), np.frombuffer(data, "<u2", n, 4 * n)
    return high.astype(np.uint64) << np.uint64(16) | low


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(answers: list[dict], sizes: np.ndarray) -> np.ndarray:
    """The bits of all buckets, in the order of the keys; a bucket without an answer has none set."""
    by = {a["bucket"]: a["bits"] for a in answers or []}
    parts = [np.unpackbits(np.frombuffer(by[b], np.uint8), count=int(n)) if b in by else np.zeros(int(n), np.uint8) for b, n in enumerate(sizes)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _distinct_names(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names, those found more than once twice; and where each distinct one is first in them."""
    ordered = np.sort(names)
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, int)
    counts = np.minimum(np.diff(np.append(first, len(ordered))), 2)
    return np.repeat(ordered[first], counts), np.cumsum(counts) - counts


def _live(block: Block, answers: list[dict], buckets: int) -> np.ndarray:
    """Positions of samples whose name is found more than once, and a few more: names are looked up by 24 bits.

    Others that come with them are sorted in vain, no more; all answers see the same positions."""
    at, names = block.samples()
    sent, first = _distinct_names(names)
    found = _flags(answers, np.diff(_buckets_of(sent, NAME_BITS, buckets)))
    table = np.zeros(1 << 24, bool)
    table[sent[first[found[first]]] & np.uint64((1 << 24) - 1)] = True
    return at[table[names & np.uint64((1 << 24) - 1)]]


def _distinct_keys(block: Block, doc: np.ndarray, keys: np.ndarray, checks: np.ndarray):
    """Order of the suffixes by key, where each distinct key starts in it, and the smallest id of each."""
    order, new = _runs(keys, checks)
    first = np.flatnonzero(new)
    low = np.minimum.reduceat(block.ids[doc[order]], first) if len(first) else np.zeros(0, np.int64)
    return order, first, low


def _runs(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, ties by the second name, and where a run of ties starts in it."""
    order = np.argsort(keys)
    k, c = keys[order], checks[order]
    if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
    return order, np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])][: len(k)]


def _by_bucket(batches):
    """Lists of the rows of one bucket at a time; rows come sorted by bucket."""
    waiting: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if waiting and waiting[0]["bucket"] != row["bucket"]:
                yield waiting
                waiting = []
            waiting.append(row)
    if waiting:
        yield waiting


ANSWER = "block long, bucket int, bits binary"


def _answers(rows: list[dict], flags: np.ndarray, sizes: list[int]):
    cuts = np.split(flags, np.cumsum(sizes)[:-1])
    found = [(r["block"], r["bucket"], _bits(f)) for r, f in zip(rows, cuts) if f.any()]
    if found:
        columns = [pa.array(list(c), t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "bits"])


def lay_out(texts: DataFrame, table: str, block: int, length: int) -> None:
    """Write texts (first, key, text) of `length` bytes or more as blocks to a table bucketed by block."""
    shape = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("keys", pa.list_(pa.binary())), ("data", pa.binary())])

    def run(batches):
        number, rows, held = TaskContext.get().partitionId() << 32, [], 0

        def done():
            ids, keys, raw = zip(*rows)
            values = [[number], [list(ids)], [[len(x) for x in raw]], [list(keys)], [b"".join(raw)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, shape)], schema=shape)

        for batch in batches:
            for first, key, raw in zip(*(batch.column(c).to_pylist() for c in ("first", "key", "raw"))):
                rows.append((LAST if first is None else first, key, raw))
                held += len(raw)
                if held >= block:
                    yield done()
                    number, rows, held = number + 1, [], 0
        if rows:
            yield done()

    long = texts.filter(F.octet_length("text") >= length).select("first", "key", F.col("text").cast("binary").alias("raw"))
    made = long.mapInArrow(run, "block long, ids array<long>, sizes array<int>, keys array<binary>, data binary")
    buckets = shuffle_partitions(texts.sparkSession)
    made.write.option("compression", "zstd").bucketBy(buckets, "block").sortBy("block").saveAsTable(table)


def _gathered(answers: DataFrame, name: str) -> DataFrame:
    """One row per block, with the answers to it: a bit per key at most."""
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


def _dealt(sent: DataFrame, parts: int) -> DataFrame:
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket")


def live_samples(blocks: DataFrame, buckets: int, passes: int, length: int) -> list[DataFrame]:
    """Answers for the cover sample: names found more than once in all blocks."""

    def names(turn: int):
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block(row, length)
                    sent, _ = _distinct_names(block.samples()[1])
                    cuts = _buckets_of(sent, NAME_BITS, buckets)
                    some = [b for b in range(turn, buckets, passes) if cuts[b] < cuts[b + 1]]
                    packed = [_pack(sent[cuts[b] : cuts[b + 1]]) for b in some]
                    part = [pa.array([row["block"]] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(packed, pa.binary())]
                    yield pa.RecordBatch.from_arrays(part, ["block", "bucket", "names"])

        return run

    def ranked(batches):
        for rows in _by_bucket(batches):
            parts = [_unpack(r.pop("names")) for r in rows]
            every = np.concatenate(parts)
            order = np.argsort(every)
            ordered = every[order]
            same = ordered[1:] == ordered[:-1]
            flags = np.zeros(len(every), bool)
            flags[order] = np.r_[False, same] | np.r_[same, False]
            yield from _answers(rows, flags, [len(p) for p in parts])

    made = []
    for turn in range(passes):
        sent = blocks.mapInArrow(names(turn), "block long, bucket int, names binary")
        made.append(stored(_dealt(sent, buckets).mapInArrow(ranked, ANSWER), "samples"))
    return made


def repeated_suffixes(blocks: DataFrame, buckets: int, passes: int, length: int) -> list[DataFrame]:
    """Answers for the suffixes: keys found in a document with a smaller id than any here. blocks: with `samples`."""

    def keys(turn: int):
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block(row, length)
                    _, doc, key, check = block.suffixes(_live(block, row["samples"], buckets))
                    order, first, low = _distinct_keys(block, doc, key, check)
                    k, c = key[order[first]], check[order[first]]
                    cuts = _buckets_of(k, 64, buckets)
                    out = []
                    for b in range(turn, buckets, passes):
                        s = slice(cuts[b], cuts[b + 1])
                        if s.start < s.stop:
                            ids, place = np.unique(low[s], return_inverse=True)
                            narrow = place.astype(np.uint32 if len(ids) > 65535 else np.uint16)
                            out.append((row["block"], b, k[s].tobytes(), c[s].tobytes(), narrow.tobytes(), ids.tobytes()))
                    if out:
                        types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
                        columns = [pa.array(list(x), t) for x, t in zip(zip(*out), types)]
                        yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "keys", "checks", "places", "ids"])

        return run

    def ranked(batches):
        for rows in _by_bucket(batches):
            parts = [np.frombuffer(r.pop("keys"), np.uint64) for r in rows]
            every = np.concatenate(parts)
            check = np.concatenate([np.frombuffer(r.pop("checks"), np.uint32) for r in rows])
            low = []
            for r in rows:
                ids = np.frombuffer(r.pop("ids"), np.int64)
                low.append(ids[np.frombuffer(r.pop("places"), np.uint32 if len(ids) > 65535 else np.uint16)])
            low = np.concatenate(low)
            order, new = _runs(every, check)
            least = np.minimum.reduceat(low[order], np.flatnonzero(new))
            flags = np.zeros(len(every), bool)
            flags[order] = least[np.cumsum(new) - 1] < low[order]
            yield from _answers(rows, flags, [len(p) for p in parts])

    made = []
    schema = "block long, bucket int, keys binary, checks binary, places binary, ids binary"
    for turn in range(passes):
        sent = blocks.mapInArrow(keys(turn), schema)
        made.append(stored(_dealt(sent, buckets).mapInArrow(ranked, ANSWER), "suffixes"))
    return made


RESULT = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def cleaned(blocks: DataFrame, buckets: int, length: int) -> DataFrame:
    """For each text of the blocks (with `samples` and `suffixes`), by its key, what of it goes and the hash of the rest."""
    shape = pa.schema(
        [("key", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    )

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, length)
                at, doc, key, check = block.suffixes(_live(block, row["samples"], buckets))
                order, first, low = _distinct_keys(block, doc, key, check)
                found = _flags(row["suffixes"], np.diff(_buckets_of(key[order[first]], 64, buckets)))
                group = np.zeros(len(order), np.int64)
                group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
                hit = at[found[group] | (low[group] < block.ids[doc])]
                change = np.zeros(len(block.data) + 1, np.int32)
                change[hit] += 1  # positions differ
                change[hit + length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                out = []
                for k, a, b in zip(row["keys"], block.starts.tolist(), block.ends.tolist()):
                    part = gone[a:b]
                    edges = np.flatnonzero(np.diff(np.r_[False, part, False].astype(np.int8)))
                    spans = [{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())]
                    kept = block.data[a:b][~part].tobytes() if spans else block.data[a:b].tobytes()
                    out.append((k, b - a, int(part.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans))
                columns = [pa.array(list(c), f.type) for c, f in zip(zip(*out), shape)]
                yield pa.RecordBatch.from_arrays(columns, schema=shape)

    return blocks.mapInArrow(run, RESULT)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50, block: int = 4 << 20, passes: int = 2
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end in bytes of the text's UTF-8)."""
    assert length > MODULUS + 7
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    both = F.concat(content_key(F.col("text")), F.unhex(F.sha2("text", 256)))
    texts = rows.groupBy(content_key(F.col("text")).alias("hash"), "text").agg(F.min("doc_id").alias("first"))
    table = f"webframe_blocks_{uuid.uuid4().hex}"
    buckets = shuffle_partitions(spark)
    with spent_shuffles(spark):
        try:
            lay_out(texts.select("first", both.alias("key"), "text"), table, block, length)
            blocks = spark.table(table)
            samples = live_samples(blocks.drop("keys"), buckets, 1, length)
            known = blocks.join(_gathered(_union(samples), "samples"), "block", "left")
            suffixes = repeated_suffixes(known.drop("keys"), buckets, passes, length)
            ready = known.join(_gathered(_union(suffixes), "suffixes"), "block", "left")
            results = stored(cleaned(ready, buckets, length), "removed")
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    firsts = rows.groupBy(both.alias("key")).agg(F.min("doc_id").alias("first"))
    members = rows.select("doc_id", both.alias("key"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("whole"))
    found = members.join(firsts, "key").join(results, "key", "left")
    copy = (F.col("size") >= length) & ~F.col("doc_id").eqNullSafe(F.col("first"))
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end")))
    none = F.array().cast("array<struct<start:long,end:long>>")
    return found.select(
        "doc_id",
        F.col("size").alias("n_bytes"),
        F.when(copy, F.col("size")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(copy, span).otherwise(F.coalesce("spans", none)).alias("spans"),
    )


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out
