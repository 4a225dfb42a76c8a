"""Language-model scores of texts by a class-based bigram model (Brown classes).

P(word | word before) = P(class | class before) * P(word | class). Learns from the documents whose crc32(id as text) mod 5 is
not 1 and scores all. Letters A-Z are lower-cased, words are runs of anything but ASCII white space, and every text ends in
one end token.

* Texts are coded once, in blocks of about `block` bytes: a block has its own list of words, as 64-bit hashes, and each text is
  a run of numbers in it. Everything after that works on blocks, never on texts. Blocks are stored, read and sent to Python one
  at a time.
* Exchange clustering: a word's contexts are its left and right neighbours, the TOP most frequent words one by one, all others by
  hash into BINS. Words seen `least` times or more start in a class by their most telling context. In each round a share of
  them moves, a few at a time, each to the class that raises the likelihood of classes given contexts most. Every task moves its own
  words and keeps its own copy of the table of class and context counts, of fixed size, up to date; after the round the tables are added
  up anew, and a round that lowers the likelihood is undone. A word's vector has at most 2 * (TOP + BINS + 2) entries, however
  frequent it is.
* Rarer words and unknown ones share a class in which one more unseen word has its share; the end token has a class, and the
  start of a text is a context of its own.
* Transitions are smoothed by the classes' own shares (weight PRIOR), so every text has a finite score and the
  probabilities of all words after any word add up to one.

Null and empty texts are a lone end token. A null id counts as not held out. Repeated rows count as often as they occur. Very long
texts are a block of their own. An empty table gives no rows; without training rows all words are unknown. Two words are told
apart by their hash: among 10 million words the chance that any two share one is 3 in a million. Only the id and the text
are read, whatever other columns are called."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.llm.shared import Steps, shuffle_partitions, small_batches

CLASSES, TOP, BINS = 64, 96, 32
CONTEXTS = TOP + BINS + 2  # and the start and the end of a text
START_CONTEXT, END_CONTEXT = CONTEXTS - 2, CONTEXTS - 1
RARE, END, START = CLASSES, CLASSES + 1, CLASSES + 2
STATES = CLASSES + 3
PRIOR = 5.0
#: Words that move at a time.
FEW = 16
BLOCK = 8 << 20
#: Tokens whose transitions a task holds at a time.
PIECE = 1 << 20
CODED = "block long, doc_id array<long>, held_out array<boolean>, size array<int>, word array<long>, codes binary"


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def coded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """CODED rows. Number 0 of every block is the end token, with the hash of the empty word."""
    ids = F.col(doc_id).cast("long")
    rows = docs.select(ids.alias("doc_id"), held_out(ids).alias("held_out"), F.col(text).alias("text"))

    def run(batches):
        import xxhash

        part, made = TaskContext.get().partitionId(), 0
        known: dict[bytes, int] = {b"": 0}
        ids, held, sizes, codes, length = [], [], [], [], 0

        def whole() -> pa.RecordBatch:
            nonlocal known, ids, held, sizes, codes, length, made
            hashes = [xxhash.xxh3_64_intdigest(w) for w in known]
            word = np.array(hashes, np.uint64).view(np.int64)
            columns = [
                pa.array([part << 32 | made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                pa.array([sizes], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(word)], pa.int32()), pa.array(word)),
                pa.array([np.concatenate(codes).tobytes()], pa.binary()),
            ]
            known, ids, held, sizes, codes, length, made = {b"": 0}, [], [], [], [], 0, made + 1
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CODED.split(", ")])

        for batch in batches:
            for i in range(batch.num_rows):
                raw = (batch.column(2)[i].as_py() or "").encode().lower()
                if length and length + len(raw) > block:
                    yield whole()
                get = known.setdefault
                own = np.fromiter((get(w, len(known)) for w in raw.split()), np.int32)
                codes.append(np.append(own, np.int32(0)))
                ids.append(batch.column(0)[i].as_py())
                held.append(batch.column(1)[i].as_py())
                sizes.append(len(own) + 1)
                length += len(raw) + 16
        if ids:
            yield whole()

    return rows.mapInArrow(run, CODED)


def _blocks(batches, *more: str) -> Iterator[tuple]:
    """Of each CODED row: ids, held out, sizes, words, codes, and further columns as they are."""
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda c: batch.column(c)[i]
            held = np.array(get("held_out").as_py(), bool)
            size = get("size").values.to_numpy()
            word = get("word").values.to_numpy()
            yield get("doc_id").values, held, size, word, np.frombuffer(get("codes").as_buffer(), np.int32), *(get(c) for c in more)


def _training(held: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return codes[np.repeat(~held, size)]


def frequent_words(blocks: DataFrame, n: int = TOP) -> list[int]:
    """Hashes of the words to be contexts one by one: the greatest sums of each block's 4 n most frequent training words."""

    def run(batches):
        for _, held, size, word, codes in _blocks(batches):
            counts = np.bincount(_training(held, size, codes), minlength=len(word))
            counts[0] = 0
            at = np.argsort(-counts, kind="stable")[: 4 * n]
            at = at[counts[at] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(word[at]), pa.array(counts[at])], ["word", "n"])

    found = blocks.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in found.orderBy(F.desc("n"), "word").limit(n).collect()]


def _contexts(word: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The context that each of a block's words is; `top` is sorted."""
    context = TOP + (word.view(np.uint64) % np.uint64(BINS)).astype(np.int64)
    at = np.minimum(np.searchsorted(top, word), max(0, len(top) - 1))
    if len(top):
        context = np.where(top[at] == word, at, context)
    context[0] = END_CONTEXT
    return context


def _packed(values: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of (value, count), as one binary of pairs of 32-bit numbers per run."""
    pairs = np.stack([values, counts], axis=1).astype(np.int32)
    offsets = np.append(starts, len(pairs)).astype(np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pairs.tobytes())])


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def word_contexts(blocks: DataFrame, top: list[int]) -> DataFrame:
    """word, n, pairs: each training word (and the end token), how often it occurs, and how often with each context; left
    contexts come first, then right ones. Each block counts its own; the parts of a word meet sorted by word."""
    known = np.sort(np.array(top, np.int64))

    def count(batches):
        for _, held, size, word, codes in _blocks(batches):
            keep = _training(held, size, codes)
            if not len(keep):
                continue
            context = _contexts(word, known)
            ends = np.flatnonzero(keep == 0)
            left = np.r_[START_CONTEXT, context[keep[:-1]]]
            left[ends[:-1] + 1] = START_CONTEXT
            right = keep[:-1].astype(np.int64) * 2 * CONTEXTS + CONTEXTS + context[keep[1:]]
            keys = np.concatenate([keep.astype(np.int64) * 2 * CONTEXTS + left, right[keep[:-1] != 0]])
            keys, counts = np.unique(keys, return_counts=True)
            at = _runs(keys // (2 * CONTEXTS))
            which = word[(keys[at] // (2 * CONTEXTS))]
            yield pa.RecordBatch.from_arrays([pa.array(which), _packed(keys % (2 * CONTEXTS), counts, at)], ["word", "pairs"])

    def add(batches):
        kept = None
        schema = ["word", "n", "pairs"]

        def summed(words: np.ndarray, sizes: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
            place = np.cumsum(np.r_[0, words[1:] != words[:-1]])
            keys = np.repeat(place, sizes) * 2 * CONTEXTS + pairs[:, 0]
            keys, back = np.unique(keys, return_inverse=True)
            n = np.bincount(back, pairs[:, 1]).astype(np.int64)
            at = _runs(keys // (2 * CONTEXTS))
            lefts = np.where(keys % (2 * CONTEXTS) < CONTEXTS, n, 0)
            total = np.add.reduceat(lefts, at)
            return pa.RecordBatch.from_arrays([pa.array(words[_runs(words)]), pa.array(total), _packed(keys % (2 * CONTEXTS), n, at)], schema)

        for batch in batches:
            words = batch.column("word").to_numpy()
            own = batch.column("pairs").cast(pa.large_binary())
            raw = np.frombuffer(b"".join(own.to_pylist()), np.int32).reshape(-1, 2)
            sizes = np.array([len(x) // 8 for x in own.to_pylist()], np.int64)
            if kept is not None:
                words, sizes, raw = (np.concatenate(x) for x in zip(kept, (words, sizes, raw)))
            whole = int(np.searchsorted(words, words[-1])) if len(words) else 0  # the last word may go on in the next batch
            cut = int(sizes[:whole].sum())
            kept = words[whole:], sizes[whole:], raw[cut:]
            if whole:
                yield summed(words[:whole], sizes[:whole], raw[:cut])
        if kept is not None and len(kept[0]):
            yield summed(*kept)

    parts = blocks.mapInArrow(count, "word long, pairs binary").repartition(shuffle_partitions(blocks.sparkSession), "word")
    return parts.sortWithinPartitions("word").mapInArrow(add, "word long, n long, pairs binary")


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's words: the row, the context and the count of every pair."""
    raw = batch.column("pairs").to_pylist()
    sizes = np.array([len(x) // 8 for x in raw], np.int64)
    pairs = np.frombuffer(b"".join(raw), np.int32).reshape(-1, 2)
    return np.repeat(np.arange(len(raw)), sizes), pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """The part of the log-likelihood of contexts given classes that depends on the classes, of a table class x context."""
    left, right = table[:, :CONTEXTS], table[:, CONTEXTS:]
    return float(_xlogx(table).sum() - _xlogx(left.sum(axis=1)).sum() - _xlogx(right.sum(axis=1)).sum())


def best_classes(row: np.ndarray, context: np.ndarray, count: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each word that gives the greatest likelihood when it alone is taken out of its own and put there.

    Of equally good ones the word's own, then the smallest."""
    out = own.copy()
    if not len(row):
        return out
    start = _runs(row)
    word = row[start]  # words without a pair stay where they are
    side = context >= CONTEXTS
    lefts, rights = np.add.reduceat(np.where(side, 0, count), start), np.add.reduceat(np.where(side, count, 0), start)
    n = count[:, None].astype(np.float64)
    now = table[:, context].T.astype(np.float64)
    at = own[row]
    place = np.arange(len(row))
    now[place, at] -= count
    gain = np.add.reduceat(_xlogx(now + n) - _xlogx(now), start, axis=0)
    each = np.arange(len(word))
    for total, columns in ((lefts, slice(0, CONTEXTS)), (rights, slice(CONTEXTS, None))):
        sums = np.repeat(table[:, columns].sum(axis=1)[None, :].astype(np.float64), len(word), axis=0)
        sums[each, own[word]] -= total
        gain -= _xlogx(sums + total[:, None]) - _xlogx(sums)
    better = gain.argmax(axis=1)
    stay = gain[each, own[word]] >= gain[each, better] - 1e-9
    out[word] = np.where(stay, own[word], better)
    return out


def clustered(words: DataFrame, rounds: int, shares: int, steps: Steps) -> DataFrame:
    """word, class: `words` (word, n, pairs) by exchange. In round r the words whose hash mod `shares` is r mod shares move."""

    def table_of(rows: DataFrame) -> np.ndarray:
        def run(batches):
            found = np.zeros((CLASSES, 2 * CONTEXTS), np.int64)
            for batch in batches:
                row, context, count = _vectors(batch)
                np.add.at(found, (batch.column("class").to_numpy()[row], context), count)
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found.ravel()[at])], ["at", "n"])

        table = np.zeros(CLASSES * 2 * CONTEXTS, np.int64)
        for r in rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            table[r["at"]] = r["n"]
        return table.reshape(CLASSES, 2 * CONTEXTS)

    def placed(rows: DataFrame, choose) -> DataFrame:
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    columns = [part.column(c) for c in ("word", "n", "pairs")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(choose(part).astype(np.int32))], ["word", "n", "pairs", "class"])

        return steps.stored(rows.mapInArrow(run, "word long, n long, pairs binary, class int"), "classes")

    def telling(totals: np.ndarray):
        """The context that is most above its share, by the square root of its size."""

        def choose(batch):
            row, context, count = _vectors(batch)
            score = count / np.sqrt(np.maximum(1, totals[context]))
            order = np.lexsort((context, -score, row))
            first = order[_runs(row[order])]
            out = np.zeros(batch.num_rows, np.int64)
            out[row[first]] = context[first] % CLASSES
            return out

        return choose

    def moved(sent, turn: int):
        local = sent.copy()  # a task's own

        def choose(batch):
            own = batch.column("class").to_numpy().astype(np.int64)
            row, context, count = _vectors(batch)
            may = (batch.column("word").to_numpy().view(np.uint64) >> np.uint64(7)) % np.uint64(shares) == np.uint64(turn % shares)
            on = may[row]
            row, context, count = row[on], context[on], count[on]
            starts = np.append(_runs(row), len(row))
            few = min(FEW, max(1, len(starts) // 32))
            for at in range(0, len(starts) - 1, few):
                some = slice(starts[at], starts[min(at + few, len(starts) - 1)])
                r, c, n = row[some], context[some], count[some]
                new = best_classes(r - r[0], c, n, own[r[0] : r[-1] + 1], local)
                was, now = own[r], new[r - r[0]]
                gone = was != now
                np.add.at(local, (was[gone], c[gone]), -n[gone])
                np.add.at(local, (now[gone], c[gone]), n[gone])
                own[r[0] : r[-1] + 1] = new
            return own

        return choose

    totals = table_of(words.select("pairs", F.lit(0).alias("class")))[0]
    now = placed(words, telling(totals))
    table = table_of(now)
    for turn in range(rounds):
        after = placed(now, moved(table, turn))
        new = table_of(after)
        better = likelihood(new) > likelihood(table)
        steps.drop(now if better else after)
        if better:
            now, table = after, new
    return now


def _looked_up(blocks: DataFrame, words: DataFrame, rare: tuple[float, float], class_n: np.ndarray, base: tuple[float, float]) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, emission, classes: each text with the classes of its tokens, a byte each.

    Of a block's words only numbers move: its words meet their counts and classes, and these meet the block's texts."""
    each = blocks.select("block", F.posexplode("word").alias("at", "word"))
    found = each.join(words, "word").select(F.col("block").alias("of"), "at", "n", "class")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, classes binary"
    names = [c.split()[0] for c in schema.split(", ")]
    added, all_n = base
    spare, rare_n = rare

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at, seen = right.column("at").to_numpy(), right.column("n").to_numpy()
        kind = right.column("class").to_numpy()
        out = []
        for ids, held, size, word, codes in _blocks(left.to_batches()):
            n, c = np.zeros(len(word), np.int64), np.full(len(word), RARE, np.uint8)
            n[at], c[at] = seen, kind
            c[0] = END
            score = np.log10((n + added) / all_n)
            emit = np.where(c == RARE, np.log10((n + spare) / rare_n), np.log10(np.maximum(1, n) / np.maximum(1, class_n[c])))
            emit[0] = 0.0
            starts = np.r_[0, np.cumsum(size)[:-1]]
            known = np.add.reduceat((n > 0).astype(np.int64)[codes], starts)
            classes = c[codes]
            offsets = np.r_[starts, len(codes)].astype(np.int32)
            bytes_ = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(classes.tobytes())])
            columns = [
                ids, pa.array(held), pa.array(size.astype(np.int64)), pa.array(known), pa.array(np.add.reduceat(score[codes], starts)),
                pa.array(np.add.reduceat(emit[codes], starts)), bytes_,
            ]
            out.append(pa.RecordBatch.from_arrays(columns, names))
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        return pa.Table.from_batches(out, pa.schema(list(zip(names, types))))

    return blocks.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(run, schema)


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The transitions of a batch's texts (class before * STATES + class), where each text begins, and the number of the first one.

    About PIECE tokens at a time: of whole texts, or a piece of a longer one, which then goes on at place 0 of the next."""
    if not batch.num_rows:
        return
    column = batch.column("classes").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + batch.num_rows + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)
    at, begin = 0, int(ends[0])
    while at < batch.num_rows:
        next_ = max(at + 1, int(np.searchsorted(ends, begin + PIECE, "right")) - 1)
        stop = min(int(ends[next_]), begin + PIECE) if next_ == at + 1 else int(ends[next_])
        classes = raw[begin:stop].astype(np.int32)
        starts = np.maximum(ends[at:next_] - begin, 0)
        before = np.r_[np.int32(START if begin == ends[at] else raw[begin - 1]), classes[:-1]]
        before[starts[1:]] = START
        yield before * np.int32(STATES) + classes, starts, at
        at, begin = (next_, stop) if stop == ends[next_] else (at, stop)


def transitions(texts: DataFrame) -> np.ndarray:
    """How often each class follows each in training texts."""

    def run(batches):
        found = np.zeros(STATES * STATES, np.int64)
        for batch in batches:
            for step, _, _ in _steps(batch):
                found += np.bincount(step, minlength=STATES * STATES)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["at", "n"])

    out = np.zeros(STATES * STATES, np.int64)
    for r in texts.filter("not held_out").select("classes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(STATES, STATES)


def smoothed(counts: np.ndarray) -> np.ndarray:
    """log10 P(class | class before); rows add up to one over all classes but the start."""
    shares = counts.sum(axis=0) + 0.5
    shares[START] = 0.0
    shares = shares / shares.sum()
    table = (counts + PRIOR * shares) / (counts.sum(axis=1, keepdims=True) + PRIOR)
    return np.log10(np.maximum(table, 1e-300))


def scored(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10, rounds: int = 4, shares: int = 2, block: int = BLOCK
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row per document."""
    steps = Steps(docs.sparkSession)
    with small_batches(docs.sparkSession, block):
        blocks = steps.stored(coded(docs, doc_id, text, block), "coded", group_rows=1)
        words = steps.stored(word_contexts(blocks, frequent_words(blocks)), "words")
    word, n = F.col("word") != F.lit(_end_hash()), F.col("n")
    sums = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
        F.coalesce(F.sum(F.when(word & (n < least), n)), F.lit(0)).alias("rare_n"), F.count_if(word & (n < least)).alias("rare_v"),
    ).first()
    classes = clustered(words.filter(word & (n >= least)), rounds, shares, steps)
    kind = F.coalesce("class", F.lit(RARE)).alias("class")
    placed = steps.stored(words.select("word", "n").join(classes.select("word", "class"), "word", "left").select("word", "n", kind), "placed")
    steps.drop(words)
    steps.drop(classes)
    class_n = np.zeros(STATES, np.int64)
    for r in placed.groupBy("class").agg(F.sum("n").alias("n")).collect():
        class_n[r["class"]] = r["n"]
    rare = 0.5, sums["rare_n"] + 0.5 * (sums["rare_v"] + 1)
    base = 0.5, sums["n"] + 0.5 * (sums["v"] + 1)
    with small_batches(docs.sparkSession, block):
        texts = steps.stored(_looked_up(blocks, placed, rare, class_n, base), "classed")
    steps.drop(blocks)
    steps.drop(placed)
    table = smoothed(transitions(texts)).ravel()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = batch.column("emission").to_numpy().copy()
                for step, starts, at in _steps(batch):
                    score[at : at + len(starts)] += np.add.reduceat(table[step], starts)
                kept = [batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
                all_ = pa.array(np.full(batch.num_rows, sums["n"], np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*kept, all_, batch.column("base_score"), pa.array(score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return texts.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _end_hash() -> int:
    import xxhash

    return int(np.array([xxhash.xxh3_64_intdigest(b"")], np.uint64).view(np.int64)[0])
