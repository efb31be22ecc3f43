"""Gradient-boosted trees for two classes, on numpy histograms, and isotonic calibration.

Fitting is for bounded samples; a fitted model is a few small arrays that tasks apply to whole batches at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray      # trees x inner nodes; a value above it goes right
    value: np.ndarray    # trees x leaves
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 3, rate: float = 0.2,
              ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Logistic loss, second-order gains, complete trees of ``depth`` levels. ``least`` is the smallest Hessian sum of a child."""
    w = np.ones(len(y)) if weight is None else weight
    inner, n, width = 2**depth - 1, len(y), x.shape[1] if x.ndim == 2 else 0
    share = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3) if n else 0.5
    model = Trees(np.zeros((trees if n else 0, inner), dtype=np.int64), np.full((trees if n else 0, inner), np.inf), np.zeros((trees if n else 0, inner + 1)), float(np.log(share / (1 - share))))
    if not n:
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(n, model.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (y - p), w * np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            best_gain, best = np.full(count, 1e-9), [(0, np.inf)] * count
            for f in range(width):
                slot = at * BINS + binned[:, f]
                gs = np.bincount(slot, g, count * BINS).reshape(count, BINS).cumsum(axis=1)
                hs = np.bincount(slot, h, count * BINS).reshape(count, BINS).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                gain[(hs < least) | (ha - hs < least)] = -1
                gain[:, len(edges[f]):] = -1
                pick = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(count), pick] > best_gain):
                    best_gain[k], best[k] = gain[k, pick[k]], (f, edges[f][pick[k]])
            for k, (f, cut) in enumerate(best):
                model.feature[t, first + k], model.cut[t, first + k] = f, cut
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t, node]] > model.cut[t, node])
        leaf = node - inner
        model.value[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += model.value[t, leaf]
    return model


@dataclass
class Isotonic:
    at: np.ndarray
    share: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.share) if len(self.at) else 1 / (1 + np.exp(-margin))


def fit_isotonic(margin: np.ndarray, y: np.ndarray, prior: float = 0.5, weight: np.ndarray | None = None) -> Isotonic:
    """Pool adjacent violators on the sorted margins; every pool is drawn a little towards the overall share, so that no score is 0 or 1,
    and stands at its mean margin: scores in between are interpolated."""
    order = np.argsort(margin, kind="stable")
    w = np.ones(len(y)) if weight is None else weight
    overall = np.average(y, weights=w) if len(y) else 0.5
    pools: list[list[float]] = []  # weighted sum of labels, weight, weighted sum of margins
    for m, label, size in zip(margin[order].tolist(), y[order].tolist(), w[order].tolist()):
        pools.append([label * size, size, m * size])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, total = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + total]
    share = np.array([(s + prior * overall) / (n + prior) for s, n, _ in pools])
    return Isotonic(np.array([total / n for _, n, total in pools]), np.maximum.accumulate(share) if len(share) else share)
