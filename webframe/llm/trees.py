"""Gradient-boosted decision trees for small tables of bounded size, in numpy.

Logistic loss, trees of fixed depth over features cut at quantiles; a calibration turns raw scores into
probabilities with two numbers (a logistic fit on held-out rows)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH = 3
CUTS = 32


@dataclass
class Trees:
    """features, cuts: (trees, 2**DEPTH - 1), values: (trees, 2**DEPTH); base score, then the calibration a * s + b."""

    features: np.ndarray
    cuts: np.ndarray
    values: np.ndarray
    base: float
    a: float = 1.0
    b: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.features, self.cuts, self.values):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += value[node - (2**DEPTH - 1)]
        return score

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.raw(x) + self.b, -35, 35)))


def _tree(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, ridge: float):
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(x), np.int64)
    for at in range(inner):
        here = node == at
        best = 1e-9
        if here.any():
            gs, hs = g[here], h[here]
            whole = gs.sum() ** 2 / (hs.sum() + ridge)
            for f, edge in enumerate(edges):
                b = binned[here, f]
                gl = np.cumsum(np.bincount(b, gs, len(edge) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, hs, len(edge) + 1))[:-1]
                if not len(gl):
                    continue
                gain = gl**2 / (hl + ridge) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + ridge) - whole
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[at], cut[at] = gain[k], f, edge[k]
        node[here] = 2 * at + 1 + (x[here, feature[at]] > cut[at])
    leaf = node - inner
    value = -np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
    return feature, cut, value, leaf


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Trees fitted to rows x with labels y in {0, 1}; no rows give a model that answers 0.5."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    edges = [e[e < c.max()] if len(c) else e for e, c in zip(edges, x.T)]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1) if len(x) else x.astype(int)
    rate_of = np.clip((y * weight).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3) if len(x) else 0.5
    made = Trees(np.zeros((0, 7), int), np.zeros((0, 7)), np.zeros((0, 8)), float(np.log(rate_of / (1 - rate_of))))
    score, rows = np.full(len(x), made.base), []
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-score))
        feature, cut, value, leaf = _tree(x, binned, edges, weight * (p - y), weight * p * (1 - p), ridge)
        score += rate * value[leaf]
        rows.append((feature, cut, rate * value))
    if rows:
        made.features, made.cuts, made.values = (np.stack(c) for c in zip(*rows))
    return made


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray, steps: int = 50) -> Trees:
    """Two numbers fitted by Newton's method on held-out rows, with labels drawn in from 0 and 1 for few rows."""
    if len(x) < 2:
        return model
    s, a, b = model.raw(x), 1.0, 0.0
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -35, 35)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - t) * s).sum() + 1e-3 * (a - 1), (p - t).sum() + 1e-3 * b])
        hess = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    model.a, model.b = float(a), float(b)
    return model
