"""Gradient-boosted trees for a two-class label, over binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS, DEPTH, TREES, RATE, MIN_ROWS, RIDGE = 32, 4, 50, 0.2, 10, 1.0


@dataclass
class Trees:
    """Complete trees in arrays: feature and threshold per inner node, value per leaf."""
    bias: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss; every level's best splits come from histograms."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.int64)
    cell = binned + np.arange(d) * BINS
    prior = np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    logit = np.full(n, np.log(prior / (1 - prior)))
    trees = Trees(float(logit[0]), np.zeros((TREES, 2**DEPTH - 1), np.int64), np.full((TREES, 2**DEPTH - 1), np.inf), np.zeros((TREES, 2**DEPTH)))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        g, h, at = (y - p) * weight, np.maximum(p * (1 - p), 1e-6) * weight, np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            place = ((at - first)[:, None] * (d * BINS) + cell).ravel()
            shape = (width, d, BINS)
            gs, hs, cs = (np.bincount(place, np.repeat(v, d), width * d * BINS).reshape(shape) for v in (g, h, np.ones(n)))
            gl, hl, cl = (np.cumsum(v, axis=2) for v in (gs, hs, cs))
            gt, ht, ct = gl[:, :, -1:], hl[:, :, -1:], cl[:, :, -1:]
            gain = gl**2 / (hl + RIDGE) + (gt - gl)**2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(cl < MIN_ROWS) | (ct - cl < MIN_ROWS)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k, b in enumerate(best):
                j, cut = divmod(int(b), BINS)
                if gain[k, j, cut] > 1e-6 and cut < len(edges[j]):
                    trees.feature[t, first + k], trees.threshold[t, first + k] = j, edges[j][cut]
            at = 2 * at + 1 + (x[np.arange(n), trees.feature[t, at]] > trees.threshold[t, at])
        leaf = at - (2**DEPTH - 1)
        trees.value[t] = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + RIDGE)
        logit += trees.value[t][leaf]
    return trees
