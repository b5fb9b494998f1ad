"""Gradient-boosted trees for two classes, small enough to train on the driver and to send to every task.

Trees are symmetric: all nodes of a level ask the same question, so a row's leaf is a number of a few bits and whole
batches are scored by comparisons of columns. Features are cut into at most ``bins`` classes at quantiles.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """A trained model: per tree the features and thresholds of its levels and the values of its leaves."""

    start: float = 0.0
    features: list[list[int]] = field(default_factory=list)
    cuts: list[list[float]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row."""
        out = np.full(len(x), self.start)
        columns = np.ascontiguousarray(x.T)
        for feats, cuts, leaves in zip(self.features, self.cuts, self.leaves, strict=True):
            leaf = np.zeros(len(x), np.int32)
            for f, c in zip(feats, cuts, strict=True):
                leaf = leaf * 2 + (columns[f] > c)
            out += leaves[leaf]
        return out


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 32, damp: float = 2.0) -> Boosted:
    """Fit by Newton steps on the logistic loss. Deterministic; an empty or one-sided sample gives a constant model."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Boosted(start=float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]).astype(np.int64)
    score = np.full(len(y), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        leaf = np.zeros(len(y), np.int64)
        feats, cuts = [], []
        for level in range(depth):
            best = (0.0, -1, 0)
            n = 1 << level
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = leaf * bins + binned[f]
                g = np.bincount(cell, grad, n * bins).reshape(n, bins).cumsum(1)
                h = np.bincount(cell, hess, n * bins).reshape(n, bins).cumsum(1)
                left, right = g[:, :-1] ** 2 / (h[:, :-1] + damp), (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + damp)
                gain = (left + right).sum(0)[: len(e)]
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            _, f, k = best
            feats.append(f)
            cuts.append(float(edges[f][k]))
            leaf = leaf * 2 + (binned[f] > k)
        g, h = np.bincount(leaf, grad, 1 << depth), np.bincount(leaf, hess, 1 << depth)
        value = rate * g / (h + damp)
        score += value[leaf]
        model.features.append(feats)
        model.cuts.append(cuts)
        model.leaves.append(value)
    return model
