"""Boosted shallow trees on binned features, fitted in numpy on a bounded sample."""

from __future__ import annotations

import numpy as np


def bin_edges(x: np.ndarray, bins: int = 32) -> list[np.ndarray]:
    """Inner bin edges of each feature, by quantiles of the sample."""
    qs = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(c, qs)) for c in x.T] if len(x) else [np.empty(0)] * x.shape[1]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T)], axis=1).astype(np.int64)


def best_split(g: np.ndarray, h: np.ndarray, l2: float = 1.0) -> tuple[float, int]:
    """(gain, bins on the left) of the best cut of a histogram of gradients; 0 bins where none helps."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gt, ht = g.sum(), h.sum()
    gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
    k = int(np.argmax(gain))
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def tree_1d(g: np.ndarray, h: np.ndarray, depth: int = 2, l2: float = 1.0) -> np.ndarray:
    """The leaf value of every bin, for a tree of this depth on one feature."""
    _, k = best_split(g, h, l2) if depth else (0.0, 0)
    if not k:
        return np.full(len(g), -g.sum() / (h.sum() + l2))
    return np.concatenate([tree_1d(g[:k], h[:k], depth - 1, l2), tree_1d(g[k:], h[k:], depth - 1, l2)])


def tree_2d(g: np.ndarray, h: np.ndarray, l2: float = 1.0) -> tuple[float, np.ndarray]:
    """(gain, leaf values) of one cut along the first axis and one along the second in each half."""
    best = (0.0, np.zeros_like(g))
    for k in range(1, len(g)):
        out, gain = np.zeros_like(g), -(g.sum() ** 2) / (h.sum() + l2)
        for part in (slice(0, k), slice(k, None)):
            gs, hs = g[part].sum(0), h[part].sum(0)
            _, m = best_split(gs, hs, l2)
            for side in (slice(0, m), slice(m, None)):
                if len(gs[side]):
                    gain += gs[side].sum() ** 2 / (hs[side].sum() + l2)
                    out[part, side] = -gs[side].sum() / (hs[side].sum() + l2)
        if gain > best[0]:
            best = (gain, out)
    return best


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def prior(y: np.ndarray) -> float:
    p = (y.sum() + 1) / (len(y) + 2)
    return float(np.log(p / (1 - p)))


class Trees:
    """Gradient-boosted trees of depth two for a binary label."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, bins: int = 24):
        self.edges, self.base, self.trees = bin_edges(x, bins), prior(y), []
        b, z = binned(x, self.edges), np.full(len(y), self.base)
        for _ in range(rounds if len(y) else 0):
            p = sigmoid(z)
            g, h = p - y, p * (1 - p)
            tree = self.grow(b, g, h, np.ones(len(y), bool), 2)
            if isinstance(tree, float):
                break
            self.trees.append(tree)
            z += rate * self.one(tree, b)
        self.rate = rate

    def grow(self, b, g, h, at, depth):
        best = (0.0, 0, 0)
        if depth:
            for f, e in enumerate(self.edges):
                gain, k = best_split(np.bincount(b[at, f], g[at], len(e) + 1), np.bincount(b[at, f], h[at], len(e) + 1))
                best = max(best, (gain, f, k))
        if not best[2]:
            return float(-g[at].sum() / (h[at].sum() + 1))
        left = b[:, best[1]] < best[2]
        return (best[1], best[2], self.grow(b, g, h, at & left, depth - 1), self.grow(b, g, h, at & ~left, depth - 1))

    def one(self, tree, b):
        if isinstance(tree, float):
            return np.full(len(b), tree)
        f, k, left, right = tree
        return np.where(b[:, f] < k, self.one(left, b), self.one(right, b))

    def score(self, x: np.ndarray) -> np.ndarray:
        b, z = binned(x, self.edges), np.full(len(x), self.base)
        for tree in self.trees:
            z = z + self.rate * self.one(tree, b)
        return sigmoid(z)


class Gam:
    """A generalised additive model with pairwise interactions.

    Trees of depth two are boosted one feature after the other, round by
    round, and summed into a table for each feature; then the pairs with the
    largest gain on what is left get tables of their own the same way.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, n_pairs: int = 8, pair_bins: int = 8, pair_rounds: int = 40):
        n, k = x.shape
        self.edges, self.coarse, self.base = bin_edges(x, bins), bin_edges(x, pair_bins), prior(y)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if not n:
            return
        b, c, z = binned(x, self.edges), binned(x, self.coarse), np.full(n, self.base)
        for _ in range(rounds):
            for f in range(k):
                p = sigmoid(z)
                m = len(self.tables[f])
                step = rate * tree_1d(np.bincount(b[:, f], p - y, m), np.bincount(b[:, f], p * (1 - p), m))
                self.tables[f] += step
                z += step[b[:, f]]

        def grid(i, j):
            p, w = sigmoid(z), len(self.coarse[j]) + 1
            at, shape = c[:, i] * w + c[:, j], (len(self.coarse[i]) + 1, w)
            size = shape[0] * shape[1]
            return np.bincount(at, p - y, size).reshape(shape), np.bincount(at, p * (1 - p), size).reshape(shape)

        gains = sorted(((tree_2d(*grid(i, j))[0], i, j) for i in range(k) for j in range(i + 1, k)), reverse=True)
        chosen = [(i, j) for gain, i, j in gains[:n_pairs] if gain > 0]
        tables = {ij: np.zeros((len(self.coarse[ij[0]]) + 1, len(self.coarse[ij[1]]) + 1)) for ij in chosen}
        for _ in range(pair_rounds):
            for i, j in chosen:
                step = rate * tree_2d(*grid(i, j))[1]
                tables[i, j] += step
                z += step[c[:, i], c[:, j]]
        self.pairs = [(i, j, t) for (i, j), t in tables.items()]

    def score(self, x: np.ndarray) -> np.ndarray:
        b, c, z = binned(x, self.edges), binned(x, self.coarse), np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        for i, j, t in self.pairs:
            z += t[c[:, i], c[:, j]]
        return sigmoid(z)
