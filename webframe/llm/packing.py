"""Packing of tokenised documents into sequences of bounded length.

A document's ids, with the end id, are cut into runs of the capacity and a rest. Pieces are dealt into
random groups of about `group_pieces`, and each group is packed on its own by first-fit decreasing: pieces
by falling length, each into the first bin with room. A tournament tree over the bins' free room finds
that bin in logarithmic time. A group's pieces are a few numbers each and their count is bounded.

Only numbers are shuffled, never ids. Pieces are written once with a number of their own before they are
dealt, so groups do not change when tasks run again, and rows that repeat an id (or all have the same)
are spread like any others. Null and empty texts are packed as their end id alone; null ids stay null. Only
the id and text are read; other columns may have any name."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.llm.shared import blocks_of, shuffle_partitions, stored, worker_state

CAPACITY = 4096
END = 2
CACHED_WORDS = 800_000
END_OF_WORD = "</w>"


def stays_letters(word: str) -> bool:
    """Whether a word is letters, and still is once the tokenizer has composed and lowered it: a letter that turns into
    a letter and a mark (U+0130, U+095D) makes one token with a full stop after it."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class WordEncoder:
    """Ids of texts by a tokenizer of words: its tokens never reach over a space or line end, it takes no notice of
    ASCII capitals, and the last token of a run of letters has the mark END_OF_WORD.

    Words (runs between spaces and line ends) are encoded once and kept, up to CACHED_WORDS of them. New runs of
    letters are encoded many in one text, and told apart by the mark. A special token that stands in a text, as it is
    written in the vocabulary, is its id, as the library has it; what stands before and after it is encoded by itself."""

    def __init__(self, spec: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.tokenizer.encode_special_tokens = True  # words never hold one: they are cut out before
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith(END_OF_WORD)
        tokens = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.special = re.compile("|".join(map(re.escape, sorted(tokens, key=len, reverse=True))) or "(?!)")
        # no word holds a line end
        self.fixed = {"": b""} | {"\n" + t: np.array([i], "<u4").tobytes() for t, i in tokens.items()}
        self.known = dict(self.fixed)
        self.tails = dict(zip(".,", self._ids([".", ","])))

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """The ids of runs of letters."""
        lines = [" ".join(words[at : at + 500]) for at in range(0, len(words), 500)]
        found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.zeros(0, "<u4")
        stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(stops) != len(words):  # a letter that the tokenizer takes apart
            return self._ids(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def _learn(self, words: set[str]) -> None:
        bases = {w[:-1] if w[-1] in self.tails else w for w in words}
        plain = {b for b in bases if stays_letters(b)}
        letters = [b for b in plain if b not in self.known]
        self.known.update(zip(letters, self._letters(letters)))
        rest = []
        for w in words:
            if w[-1] in self.tails and w[:-1] in plain:
                self.known[w] = self.known[w[:-1]] + self.tails[w[-1]]
            elif w not in self.known:
                rest.append(w)
        self.known.update(zip(rest, self._ids(rest)))

    def _words(self, text: str) -> list[str]:
        """The words, and special tokens after a line end."""
        out: list[str] = []
        at = 0
        for m in self.special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append("\n" + m.group())
            at = m.end()
        return out + self._plain(text[at:]) if at else self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        return text.encode().lower().decode().replace("\n", " ").split(" ")

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids, little-endian unsigned 32-bit."""
        split = [self._words(t) if t else [] for t in texts]
        words = set().union(*split)
        new = words - self.known.keys()
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known = dict(self.fixed)
            new = words - self.known.keys()
        self._learn(new)
        return [b"".join(map(self.known.__getitem__, w)) for w in split]


def _encoder(spec: bytes) -> WordEncoder:
    state = worker_state("packing")
    key = (len(spec), zlib.crc32(spec))
    if getattr(state, "word_encoder", (None,))[0] != key:
        state.word_encoder = (key, WordEncoder(spec))
    return state.word_encoder[1]


def pieces(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, and with `with_ids` the ids (little-endian unsigned 32-bit).

    `tokenizer` is the path of the tokenizer's file on the driver; its content, of fixed size, is broadcast."""
    with open(tokenizer, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    shape = pa.schema(fields + ([("ids", pa.binary())] if with_ids else []))
    last = np.array([end], "<u4").tobytes()
    width = 4 * capacity

    def run(batches):
        encode = _encoder(spec.value)
        for part in blocks_of(batches, "text", 4 << 20):
            out = []
            for i, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                ids += last
                for at in range(0, len(ids), width):
                    piece = ids[at : at + width]
                    row = (i, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)
                    out.append(row + (piece,) if with_ids else row)
            columns = zip(*out) if out else [[]] * len(shape)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, shape)], schema=shape)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return rows.mapInArrow(run, schema + ", ids binary" if with_ids else schema)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, at most `capacity` each.

    The tree's leaves are the bins' free room, its inner nodes the larger of two children; a piece goes down
    to the leftmost leaf with room."""
    n = len(lengths)
    size = 1 << max(0, math.ceil(math.log2(max(1, n))))
    room = [capacity] * (2 * size)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < size:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - size, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def packed(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = 16_384, seed: int = 42) -> DataFrame:
    """cut (a table of `pieces`) with sequence_id and offset; offsets within a sequence are gapless from 0."""
    spark = cut.sparkSession
    fixed = stored(cut.withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    groups = max(1, math.ceil(fixed.count() / group_pieces))
    dealt = fixed.withColumn("_group", F.pmod(F.xxhash64("_piece", F.lit(seed)), F.lit(groups)))
    narrow = dealt.repartition(min(groups, max(shuffle_partitions(spark), 1)), "_group").sortWithinPartitions("_group", "_piece")
    names = [*cut.columns, "_group"]

    def run(batches):
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
            group = table.column("_group").to_numpy()
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
            for a, b in zip(starts[:-1], starts[1:]):
                yield from one(table.slice(a, b - a))
            waiting = table.slice(starts[-1]) if len(starts) else table
        if waiting is not None and waiting.num_rows:
            yield from one(waiting)

    def one(table: pa.Table):
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        ids = table.column("_group").to_numpy() * (1 << 32) + bins
        made = table.select(list(cut_names)).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))
        yield from made.to_batches()

    cut_names = tuple(cut.columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return narrow.select(*names).mapInArrow(run, f"{schema}, sequence_id long, offset long")
