"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Entries c become whole numbers x = floor(64 * c) + 1000000, so sums and distances from the mean are exact. Tasks add up
n, the sums and the centred scatter of their rows; the driver is sent those of all rows, a matrix of d x d numbers (d is the
length of a vector), never rows. With P'AP = LL', rotations of pairs of columns make those of PL orthogonal: their squared
norms are the eigenvalues of the scatter A and the columns, normalised, its eigenvectors. No d x d eigenproblem is formed
anew, so small eigenvalues keep their digits.

Vectors that are null or empty, hold null or non-finite entries, or have another length than most (of lengths that are
equally common, the greatest counts) are dropped. Entries beyond long saturate, as in a Spark cast; a deviation beyond long is
null. Repeated rows count as often as they occur; null ids are kept. Directions without variance, to rounding, have no
component, so fewer rows than asked for come out where the vectors span less. An empty table gives no rows. Only the id and
the vector are read, whatever other columns are called."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
LIMIT = 2**63
SWEEPS = 60


def whole(block: np.ndarray) -> np.ndarray:
    """The entries as whole numbers, saturated at the bounds of long."""
    scaled = np.floor(SCALE * block.astype(np.float64)) + SHIFT
    safe = np.clip(scaled, -float(LIMIT), float(LIMIT - 1024))
    out = safe.astype(np.int64)
    out[scaled >= LIMIT] = LIMIT - 1
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """F with F F' = a (positive semidefinite): the triangular factor with its rows put back in place.

    Stops where no pivot is left beyond rounding, so F has as many columns as a has directions."""
    d = len(a)
    rest = np.diag(a).astype(np.float64)
    factor = np.zeros((d, d))
    least = d * np.finfo(float).eps * rest.max(initial=0.0)
    done = np.zeros(d, bool)
    for k in range(d):
        at = int(np.argmax(np.where(done, -np.inf, rest)))
        if done[at] or rest[at] <= least:
            return factor[:, :k]
        column = (a[:, at] - factor[:, :k] @ factor[at, :k]) / np.sqrt(rest[at])
        column[done] = 0.0
        column[at] = np.sqrt(rest[at])
        factor[:, k] = column
        done[at] = True
        rest = rest - column**2
    return factor


def _rounds(n: int):
    """Disjoint pairs of columns, round by round, until each pair has met once."""
    even = n + n % 2
    ring = list(range(even))
    for _ in range(even - 1):
        pairs = [(ring[i], ring[even - 1 - i]) for i in range(even // 2)]
        yield np.array([(min(p), max(p)) for p in pairs if max(p) < n]).reshape(-1, 2).T
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor's columns rotated pair by pair until all are orthogonal, the longest first."""
    u = factor.copy()
    n = u.shape[1]
    rounds = list(_rounds(n)) if n > 1 else []
    for _ in range(SWEEPS):
        turned = False
        for i, j in rounds:
            x, y = u[:, i], u[:, j]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            on = np.abs(xy) > 1e-15 * np.sqrt(xx * yy)
            if not on.any():
                continue
            turned = True
            i, j, x, y = i[on], j[on], x[:, on], y[:, on]
            zeta = (yy - xx)[on] / (2 * xy[on])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.sqrt(1 + t * t)
            u[:, i], u[:, j] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    norms = np.sqrt((u * u).sum(axis=0))
    return u[:, np.argsort(-norms, kind="stable")]


def _vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.filter((F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))


def _blocks(batches, d: int):
    """Of each Arrow batch: the ids and the whole numbers, a row per vector."""
    for batch in batches:
        step = max(1, (1 << 21) // d)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part.column(0), whole(part.column(1).flatten().to_numpy().reshape(-1, d))


def _added(parts: DataFrame) -> dict[int, list]:
    """Rows (at, values...) of all tasks, added up by place: at most as many rows as there are places."""
    sums = [F.sum(c).alias(c) for c in parts.columns[1:]]
    return {r[0]: list(r[1:]) for r in parts.groupBy("at").agg(*sums).collect()}


def whitened(df: DataFrame, components: int = 32, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per kept vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = df.sparkSession
    rows = _vectors(df, vec_id, embedding)
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    d, n = common["d"], common["n"]
    rows = rows.filter(F.size("v") == d)

    def sums(batches):
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in _blocks(batches, d):
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(high), pa.array(low)], ["at", "high", "low"])

    halves = _added(rows.mapInArrow(sums, "at long, high long, low long"))
    total = [(halves[i][0] << 32) + halves[i][1] for i in range(d)]
    exact = max(map(abs, total)) + n * max(abs(t) // n + 1 for t in total) < LIMIT // 4
    mean = np.array([t / n for t in total])

    def off(x: np.ndarray) -> np.ndarray:
        """n * x - S: whole numbers, of Python's kind where they may not fit a long."""
        if exact and int(np.abs(x).max(initial=0)) * n < LIMIT // 4:
            return x * n - np.array(total, np.int64)
        return x.astype(object) * n - np.array(total, object)

    def centred(x: np.ndarray) -> np.ndarray:
        return off(x).astype(np.float64) / n

    def scatter(batches):
        found = np.zeros((d, d))
        for _, x in _blocks(batches, d):
            y = centred(x)
            found += y.T @ y
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i * d + j), pa.array(found[i, j])], ["at", "part"])

    a = np.zeros((d, d))
    for at, (value,) in _added(rows.mapInArrow(scatter, "at long, part double")).items():
        a[at // d, at % d] = a[at % d, at // d] = value
    trace = float(np.trace(a))
    u = one_sided_jacobi(pivoted_cholesky(a))[:, :components]
    k = u.shape[1]
    if not k:
        return spark.createDataFrame([], schema)
    squares = (u * u).sum(axis=0)  # the scatter's eigenvalues; those of the covariance are an n-th of them
    # projections on u / |u|, over the standard deviation |u| / sqrt(n)
    turn = u / squares * np.sqrt(n)

    def products(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches, d):
            z = centred(x) @ turn
            first += z.sum(axis=0)
            second += z.T @ z
        both = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], ["at", "part"])

    added = _added(rows.mapInArrow(products, "at long, part double"))
    both = np.array([added[i][0] for i in range(k + k * k)]) / n
    covariance = both[k:].reshape(k, k) - np.outer(both[:k], both[:k])
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = squares / trace

    def deviation(x: np.ndarray) -> list:
        y = off(x)
        if y.dtype != object and d * int(np.abs(y).max(initial=0)) ** 2 < LIMIT:
            return (y * y).sum(axis=1).tolist()
        found = [sum(v * v for v in row) for row in y.tolist()]
        return [v if v < LIMIT else None for v in found]

    def rotated(batches):
        for ids, x in _blocks(batches, d):
            z = centred(x) @ turn
            m = len(z)
            far = pa.array(deviation(x), pa.int64())
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [
                ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                far.take(each), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(rotated, schema)
