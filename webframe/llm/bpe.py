"""Byte-level BPE by monoid tree reduction, and decoding.

A text is split into halves, the halves' results are joined, and so on up the tree. Two monoids are
reduced in that way: the matches of the splitting pattern in a text, and the tokens of one match.

Matches: from the first match that ends close to the cut, the text is split anew until a match ends where
one of the right half does. Matches that end `LOOK` characters or more before a text's end cannot change
when it goes on, and what follows an equal end is equal.

Tokens: the last tokens of the left and the first of the right half are a window whose bytes are encoded
anew. It is settled when the token before it and its first token, and its last token and the one after it,
are each what their own bytes encode to: a sequence is the encoding of its bytes exactly if that holds for
all its neighbours, and inside the halves and the window it does. Else the window grows on that side.

Leaves, matches of up to `LEAF` bytes, are encoded many at a time with numpy and kept by worker, up to
CACHED of them. Ids are little-endian unsigned 32-bit numbers in a binary column. Null texts have no ids,
like empty ones. Each row is encoded on its own, so repeated rows do no harm."""

from __future__ import annotations

import base64
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.llm.shared import blocks_of, worker_state

LEAF = 32
LOOK = 3
CHUNK = 1 << 15
CACHED = 200_000
NONE = np.iinfo(np.int32).max


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern)
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.base = max(self.bytes_of) + 1
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = rank
        self.pair_rank = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.settled: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def leaves(self, parts: list[bytes]) -> list[np.ndarray]:
        """The tokens of each part, all parts merged side by side: in each the leftmost pair of the lowest rank per step."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(parts)
        which = np.array([i for i, p in enumerate(parts) if p], np.int64)
        tokens = self.byte[np.frombuffer(b"".join(parts), np.uint8)]
        sizes = np.array([len(parts[i]) for i in which], np.int64)
        ends = np.cumsum(sizes)
        rank = np.full(len(tokens), NONE)
        rank[:-1] = self._rank(tokens[:-1], tokens[1:])
        rank[ends - 1] = NONE
        while len(which):
            starts = ends - sizes
            low = np.minimum.reduceat(rank, starts)
            over = low == NONE
            if over.any():
                for i, a, b in zip(which[over].tolist(), starts[over].tolist(), ends[over].tolist()):
                    out[i] = tokens[a:b]
                stay = np.repeat(~over, sizes)
                tokens, rank = tokens[stay], rank[stay]
                which, sizes, low = which[~over], sizes[~over], low[~over]
                ends = np.cumsum(sizes)
                if not len(which):
                    break
            owner = np.repeat(np.arange(len(which)), sizes)
            hits = np.flatnonzero(rank == low[owner])
            at = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]
            tokens[at] = low
            stay = np.ones(len(tokens), bool)
            stay[at + 1] = False
            tokens, rank = tokens[stay], rank[stay]
            sizes = sizes - 1
            ends = np.cumsum(sizes)
            starts = ends - sizes
            at = at - np.arange(len(at))
            after = np.minimum(at + 1, len(tokens) - 1)
            rank[at] = np.where(at + 1 < ends, self._rank(tokens[at], tokens[after]), NONE)
            inner = at > starts
            rank[at[inner] - 1] = self._rank(tokens[at[inner] - 1], tokens[at[inner]])
        return out

    def plain(self, data: bytes) -> list[int]:
        """The tokens of some bytes, with a heap of pairs: for windows."""
        n = len(data)
        token = self.byte[np.frombuffer(data, np.uint8)].tolist()
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank, base = self.pair_rank, self.base
        heap = [(r, i, token[i], token[i + 1]) for i in range(n - 1) if (r := rank.get(token[i] * base + token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or token[i] != a or token[j] != b:
                continue
            token[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (x := rank.get(token[p] * base + token[q])) is not None:
                    heapq.heappush(heap, (x, p, token[p], token[q]))
        return [t for t, keep in zip(token, alive) if keep]

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether a, b is what their bytes encode to."""
        if (a, b) not in self.settled:
            if len(self.settled) > CACHED:
                self.settled.clear()
            self.settled[a, b] = self.plain(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self.settled[a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            if a == b == 1 and self._neighbours(left[-1], right[0]):
                return left + right
            window = self.plain(b"".join(map(self.bytes_of.__getitem__, left[-a:] + right[:b])))
            before = a == len(left) or self._neighbours(left[-a - 1], window[0])
            after = b == len(right) or self._neighbours(window[-1], right[b])
            if before and after:
                return left[: len(left) - a] + window + right[b:]
            a, b = a * (1 if before else 2), b * (1 if after else 2)

    def tree(self, leaves: list[list[int]]) -> list[int]:
        while len(leaves) > 1:
            pairs = [self.join(a, b) for a, b in zip(leaves[::2], leaves[1::2])]
            leaves = pairs + leaves[len(leaves) - len(leaves) % 2 :]
        return leaves[0] if leaves else []

    def matches(self, text: str) -> list[str]:
        """The pattern's matches in a text, which they cover whole."""
        if len(text) <= CHUNK:
            return self.split.findall(text)
        cut = len(text) // 2
        left, right = self.matches(text[:cut]), self.matches(text[cut:])
        at = cut
        while left and at > cut - LOOK:
            at -= len(left.pop())
        stops, place = {}, cut
        for i, m in enumerate(right):
            stops[place] = i
            place += len(m)
        reach = 64
        while True:
            part, place = text[at : cut + reach], at
            whole = cut + reach >= len(text)
            made = []
            for m in self.split.findall(part):
                if place in stops and place >= cut:
                    return left + made + right[stops[place] :]
                if place + len(m) > cut + reach - LOOK and not whole:
                    break
                made.append(m)
                place += len(m)
            if whole:
                return left + made
            reach *= 4

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.matches(t) if t else [] for t in texts]
        new = list(set().union(*split) - self.known.keys()) if split else []
        if len(self.known) + len(new) > CACHED:
            self.known = {}
            new = list(set().union(*split))
        for at in range(0, len(new), 100_000):
            part = new[at : at + 100_000]
            raw = [p.encode() for p in part]
            cuts = [_halved(len(r)) for r in raw]
            tokens = iter(self.leaves([r[a:b] for r, c in zip(raw, cuts) for a, b in c]))
            for word, c in zip(part, cuts):
                if len(c) == 1:
                    ids = next(tokens)
                else:
                    ids = np.array(self.tree([next(tokens).tolist() for _ in c]), np.int64)
                self.known[word] = ids.astype("<u4").tobytes()
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def _halved(n: int) -> list[tuple[int, int]]:
    """Leaves of a tree over n bytes: halves of halves, down to LEAF bytes."""
    spans = [(0, n)]
    while spans[0][1] - spans[0][0] > LEAF:
        spans = [s for a, b in spans for s in ((a, (a + b) // 2), ((a + b) // 2, b))]
    return spans


def decoded(ids: bytes | None, table: list[bytes]) -> bytes:
    """The bytes of ids, by a table of the tokens' bytes."""
    return b"".join(map(table.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens' bytes by id; ids that stand for nothing give no bytes."""
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _worker(spec: bytes, pattern: str) -> Bpe:
    state = worker_state("bpe")
    key = (len(spec), zlib.crc32(spec), pattern)
    if getattr(state, "bpe", (None,))[0] != key:
        state.bpe = (key, Bpe(read_ranks(spec), pattern))
    return state.bpe[1]


def _broadcast(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(
    docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text", check: bool = False
) -> DataFrame:
    """doc_id and ids, and with `check` also `decoded`, the bytes decoded from the ids.

    `ranks` is the path of the rank file on the driver; its content, of fixed size, is broadcast."""
    spec = _broadcast(docs, ranks)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "ids", "decoded"] if check else ["doc_id", "ids"]

    def run(batches):
        bpe = _worker(spec.value, pattern)
        table = token_table(bpe.ranks) if check else []
        for part in blocks_of(batches, "text", 2 << 20):
            ids = bpe.encode(part.column("text").to_pylist())
            columns = [part.column("doc_id"), pa.array(ids, pa.binary())]
            if check:
                columns.append(pa.array([decoded(x, table) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary" if check else "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """A table of `encode` with `decoded`, the bytes of its ids."""
    spec = _broadcast(encoded, ranks)

    def run(batches):
        table = token_table(read_ranks(spec.value))
        for part in blocks_of(batches, "ids", 4 << 20):
            raw = pa.array([decoded(x, table) for x in part.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), raw], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
