"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (0) or nothing (-1) on every text, from counts of its words, lines
and characters. Expectation-maximisation estimates each labeller's accuracy from how often each pattern of
votes occurs: votes are taken as independent given the true label, and a labeller is assumed to call few good
texts bad. A labeller that does not vote says nothing. The patterns are counted over all
texts; there are at most 3 ** len(LABELLERS) of them, so their counts fit the driver whatever the input.
The posterior label of a pattern then trains a linear scorer on hashed byte trigrams: a text's score is the
mean weight of its trigrams. The scorer is fitted on a bounded sample (`sample` texts, the smallest by a
hash of id and text); all texts are counted, voted on and scored.

A text is kept when the scorer and the posterior together (`blend` is the posterior's share in a long text, and
more in one of few trigrams) give at least `threshold`. Null texts count as empty; an empty text gets the score of its votes. Rows are judged one by
one, so repeated rows get equal results. Only the id and text are read."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.llm.shared import blocks_of, stored

DIMENSIONS = 1 << 12
SHORT = 200
LABELLERS = ("length", "symbols", "marked", "variety", "echo", "lines", "capitals", "shouting", "sentences", "separators")
#: What is assumed of every labeller: so rarely it calls a good text bad, with the weight of so many texts per text.
FALSE_ALARM, TRUST = 0.003, 2.0
SYMBOLS = re.compile(rb"[#*$%&|<>{}\\^~=]")
#: Words that end in other marks than a sentence's, or are a mark.
MARKED = re.compile(rb"[#*$%&|<>{}\\^~=_@+/!?]{2,}(?=\s|$)|(?<=\s)[|*#/=_+-](?=\s|$)")


def votes(text: bytes) -> str:
    """One letter per labeller: g for good, b for bad, a dash for no vote."""
    words = text.split()
    n = len(words)
    lines = [s for s in text.split(b"\n") if s.strip()]
    letters = max(1, sum(map(len, words)))
    kinds = len(set(words)) / max(1, n)
    capital = len(re.findall(rb"[A-Z]", text)) / letters
    ended = sum(w[-1:] in b".!?" for w in words) / max(1, n)
    lone = sum(len(w) == 1 and not w.isalnum() and w.isascii() for w in words) / max(1, n)
    marked = len(MARKED.findall(text)) / max(1, n)
    echo = sum(a == b for a, b in zip(words, words[1:])) / max(1, n)
    same = len(set(lines)) / max(1, len(lines))

    def vote(bad: bool, good: bool = False) -> str:
        return "b" if bad else "g" if good else "-"

    return "".join((
        vote(n == 0),
        vote(len(SYMBOLS.findall(text)) / letters > 0.05),
        vote(marked > 0.2, n >= 20 and marked < 0.03),
        vote(n >= 20 and kinds < 0.3, n >= 20 and kinds > 0.5),
        vote(n >= 20 and echo > 0.05),
        vote(len(lines) >= 3 and same < 0.6),
        vote(n >= 5 and capital > 0.4),
        vote(text.count(b"!!") / max(1, n) > 0.1),
        vote(n >= 50 and not 0.01 <= ended <= 0.6, n >= 20 and 0.02 < ended < 0.3),
        vote(n >= 5 and lone > 0.1),
    ))


def trigrams(text: bytes) -> np.ndarray:
    """The hashed places of the byte trigrams of a text."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1]) * np.uint32(0x85EBCA6B) + b[2:]
    return ((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 12)).astype(np.int64)


def accuracies(patterns: dict[str, int], rounds: int = 200) -> tuple[float, np.ndarray, dict[str, float]]:
    """Share of good texts, (labeller, true label, vote) probabilities, and the posterior of each pattern.

    Starts from the share of good votes, so that label 1 is the one which labellers call good."""
    keys = sorted(patterns)
    votes_of = np.array([[("b", "g", "-").index(c) for c in k] for k in keys]).reshape(len(keys), len(LABELLERS))
    n = np.array([patterns[k] for k in keys], float)
    good, bad = (votes_of == 1).sum(1), (votes_of == 0).sum(1)
    post = (good + 1) / (good + 2 * bad + 2)  # bad votes are rarer and weigh double
    share, table = 0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)
    for _ in range(rounds if len(keys) else 0):
        weight = np.stack([n * (1 - post), n * post])
        share = (weight[1].sum() + 1) / (n.sum() + 2)
        for j in range(len(LABELLERS)):
            for label in (0, 1):
                counts = np.bincount(votes_of[:, j], weight[label], 3) + 1
                if label:
                    known = TRUST * n.sum()
                    rest = counts[1:] / counts[1:].sum() * (1 - FALSE_ALARM)
                    counts += known * np.array([FALSE_ALARM, *rest])
                table[j, label] = counts / counts.sum()
        said = np.log(table[:, 1]) - np.log(table[:, 0])
        said[:, 2] = 0  # no vote says nothing
        logit = np.log(share / (1 - share)) + sum(said[j, votes_of[:, j]] for j in range(len(LABELLERS)))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return float(share), table, dict(zip(keys, post.tolist()))


def train(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights per trigram place and a bias: logistic regression on relative counts, soft labels, both classes alike in weight."""
    w, b = np.zeros(DIMENSIONS), 0.0
    if not len(y):
        return w, b
    side = np.where(y >= 0.5, 0.5 / max(1, (y >= 0.5).sum()), 0.5 / max(1, (y < 0.5).sum()))
    scale = 1 / np.maximum(x.std(0), 1e-4)
    mean = x.mean(0)
    z = (x - mean) * scale / np.sqrt(DIMENSIONS)
    m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    theta = np.zeros(DIMENSIONS + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ theta[:-1] + theta[-1], -30, 30)))
        r = side * (p - y)
        g = np.append(z.T @ r + ridge * theta[:-1], r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w = theta[:-1] * scale / np.sqrt(DIMENSIONS)
    return w, float(theta[-1] - mean @ w)


def classified(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 3000, threshold: float = 0.5, blend: float = 0.5
) -> DataFrame:
    """doc_id, votes, posterior, score, kept."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def voted(batches):
        for part in blocks_of(batches, "text", 4 << 20):
            found = [votes(t.encode()) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string()), part.column("order")], ["doc_id", "votes", "order"])

    order = F.xxhash64("doc_id", "text").alias("order")
    judged = stored(rows.select("doc_id", "text", order).mapInArrow(voted, "doc_id long, votes string, order long"), "votes")
    patterns = {r.votes: r.n for r in judged.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    _, _, posterior = accuracies(patterns)
    weights = train(*_sampled(rows.select("text", order), posterior, sum(patterns.values()), sample))

    def scored(batches):
        w, b = weights
        for part in blocks_of(batches, "text", 4 << 20):
            raw = [t.encode() for t in part.column("text").to_pylist()]
            marks = [votes(t) for t in raw]
            post = np.array([posterior.get(m, 0.5) for m in marks])
            at = [trigrams(t) for t in raw]
            mean = np.array([w[a].mean() if len(a) else 0.0 for a in at])
            line = 1 / (1 + np.exp(-np.clip(mean + b, -30, 30)))
            size = np.array([len(a) for a in at])
            share = (1 - blend) * size / (size + SHORT)
            score = (1 - share) * post + share * line
            columns = [part.column("doc_id"), pa.array(marks, pa.string()), pa.array(post), pa.array(score), pa.array(score >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "votes", "posterior", "score", "kept"])

    return rows.mapInArrow(scored, "doc_id long, votes string, posterior double, score double, kept boolean")


def _sampled(rows: DataFrame, posterior: dict[str, float], total: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Relative trigram counts and posteriors of the `sample` rows with the smallest hashes."""
    share = min(1.0, 4 * sample / max(1, total))
    near = rows.filter(F.col("order") <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64))))

    def counted(batches):
        for part in blocks_of(batches, "text", 4 << 20):
            raw = [t.encode() for t in part.column("text").to_pylist()]
            x = [(np.bincount(a, minlength=DIMENSIONS) / max(1, len(a))).astype("<f2").tobytes() for a in map(trigrams, raw)]
            y = [posterior.get(votes(t), 0.5) for t in raw]
            yield pa.RecordBatch.from_arrays([part.column("order"), pa.array(x, pa.binary()), pa.array(y)], ["order", "x", "y"])

    first = near.orderBy("order").limit(sample).select("order", "text")
    found = sorted((r.order, r.x, r.y) for r in first.mapInArrow(counted, "order long, x binary, y double").toLocalIterator())
    x = np.array([np.frombuffer(r[1], "<f2") for r in found], np.float32).reshape(-1, DIMENSIONS)
    return x, np.array([r[2] for r in found])
