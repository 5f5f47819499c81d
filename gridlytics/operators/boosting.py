"""Gradient boosting of regression trees over histograms, for one small table in numpy.

A feature is cut at quantiles of its values; a tree grows level by level, every level from one histogram of gradients and counts
over (leaf, feature, bin). Squared error: the gradient of a row is its residual, its curvature is 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Trees, depth, learning rate, leaf penalty and least weight of a leaf of the published boosting library's defaults.
TREES, DEPTH, RATE = 2000, 6, 0.3
PENALTY, LEAST_ROWS = 1.0, 1
BINS, PATIENCE = 256, 50


@dataclass
class Tree:
    """Per inner node, level by level, the feature and the last bin that goes left (-1: all); and the values of the last level."""

    features: list[np.ndarray]
    bins: list[np.ndarray]
    values: np.ndarray

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        node = np.zeros(len(codes), np.int64)
        rows = np.arange(len(codes))
        for feature, last in zip(self.features, self.bins):
            cut = last[node]
            node = 2 * node + ((cut >= 0) & (codes[rows, feature[node]] > cut))
        return node

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return self.values[self.leaves(codes)]


@dataclass
class Boosted:
    cuts: list[np.ndarray]
    base: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = coded(x, self.cuts)
        return self.base + sum((tree.predict(codes) for tree in self.trees), np.zeros(len(x)))


def cut_points(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per feature the values that bins end at: midpoints between neighbours, at quantiles where there are more than `bins` values."""
    out = []
    for column in x.T:
        values = np.unique(column)
        between = (values[1:] + values[:-1]) / 2
        if len(between) >= bins:
            between = np.unique(between[np.linspace(0, len(between) - 1, bins - 1).round().astype(int)])
        out.append(between)
    return out


def coded(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)


def grow(codes: np.ndarray, sizes: int, residual: np.ndarray, depth: int, rate: float) -> Tree:
    """One tree on the residuals. A leaf without a gainful cut keeps all its rows on the left."""
    n, width = codes.shape
    node = np.zeros(n, np.int64)
    rows, features, bins = np.arange(n), [], []
    for level in range(depth):
        leaves = 1 << level
        at = (node[:, None] * width + np.arange(width)) * sizes + codes
        shape = (leaves, width, sizes)
        sums = np.bincount(at.ravel(), weights=np.repeat(residual, width), minlength=leaves * width * sizes).reshape(shape).cumsum(axis=2)
        counts = np.bincount(at.ravel(), minlength=leaves * width * sizes).reshape(shape).cumsum(axis=2)
        total, count = sums[:, :, -1:], counts[:, :, -1:]
        gain = sums**2 / (counts + PENALTY) + (total - sums) ** 2 / (count - counts + PENALTY) - total**2 / (count + PENALTY)
        gain[(counts < LEAST_ROWS) | (count - counts < LEAST_ROWS)] = -np.inf
        flat = gain.reshape(leaves, -1)
        best = flat.argmax(axis=1)
        good = flat[np.arange(leaves), best] > 1e-12
        features.append(np.where(good, best // sizes, 0))
        bins.append(np.where(good, best % sizes, -1))
        cut = bins[-1][node]
        node = 2 * node + ((cut >= 0) & (codes[rows, features[-1][node]] > cut))
        if not good.any():
            break
    last = 1 << len(features)
    values = np.bincount(node, weights=residual, minlength=last) / (np.bincount(node, minlength=last) + PENALTY)
    return Tree(features, bins, rate * values)


def grow_one(codes: np.ndarray, counts: np.ndarray, residual: np.ndarray, depth: int, rate: float) -> tuple[Tree, np.ndarray]:
    """:func:`grow` for the codes of a single feature and the rows of each code; the tree and its value at each code.

    Nodes are runs of codes, so a level costs a few passes over the codes, however many rows and leaves there are. Sums are added in the
    order of :func:`grow`, so cuts that gain the same fall alike.
    """
    size = len(counts)
    sums = np.bincount(codes, weights=residual, minlength=size)
    rows = np.concatenate([[0], np.cumsum(counts)])
    node, features, bins = np.zeros(size, np.int64), [], []
    begins, left, place = np.zeros(1, np.int64), np.empty(size), np.arange(size)
    for level in range(depth):
        ends = np.append(begins[1:], size)
        for start, end in zip(begins, ends):
            np.cumsum(sums[start:end], out=left[start:end])
        run = np.repeat(np.arange(len(begins)), ends - begins)
        total, count = left[ends - 1], rows[ends] - rows[begins]
        below = rows[1:] - rows[begins][run]
        above = count[run] - below
        gain = left**2 / (below + PENALTY) + (total[run] - left) ** 2 / (above + PENALTY) - (total**2 / (count + PENALTY))[run]
        gain[(below < LEAST_ROWS) | (above < LEAST_ROWS)] = -np.inf
        most = np.maximum.reduceat(gain, begins)
        good = most > 1e-12
        hits = np.flatnonzero(gain == most[run])
        best = hits[np.searchsorted(hits, begins)]
        last = np.full(1 << level, -1, np.int64)
        last[node[begins[good]]] = best[good]
        features.append(np.zeros(1 << level, np.int64))
        bins.append(last)
        cut = last[node]
        node = 2 * node + ((cut >= 0) & (place > cut))
        if not good.any():
            break
        begins = np.sort(np.concatenate([begins, best[good] + 1]))
    at, leaves = node[codes], 1 << len(features)
    tree = Tree(features, bins, rate * (np.bincount(at, weights=residual, minlength=leaves) / (np.bincount(at, minlength=leaves) + PENALTY)))
    return tree, tree.values[node]


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, watched=None, patience: int = PATIENCE):
    """A boosted model; with `watched` (features, labels) only up to the number of trees that serve those rows best, looking
    `patience` trees ahead."""
    cuts = cut_points(x, bins)
    codes, sizes = coded(x, cuts), max((len(c) for c in cuts), default=0) + 1
    base = float(y.mean())
    fitted, out = np.full(len(y), base), []
    if watched is not None:
        seen, labels = coded(watched[0], cuts), watched[1]
        guess = np.full(len(labels), base)
        best, keep = float(np.mean((labels - guess) ** 2)), 0
    # Rows with the same code of a single feature share their leaf in every tree.
    single = x.shape[1] == 1
    if single:
        own = codes[:, 0]
        counts = np.bincount(own, minlength=sizes)
    for _ in range(trees):
        if single:
            tree, step = grow_one(own, counts, y - fitted, depth, rate)
        else:
            tree = grow(codes, sizes, y - fitted, depth, rate)
        if not tree.values.any():
            break
        out.append(tree)
        fitted = fitted + (step[own] if single else tree.predict(codes))
        if watched is not None:
            guess = guess + (step[seen[:, 0]] if single else tree.predict(seen))
            error = float(np.mean((labels - guess) ** 2))
            if error < best:
                best, keep = error, len(out)
            elif len(out) - keep >= patience:
                break
    return Boosted(cuts, base, out if watched is None else out[:keep])


def fit_watched(x: np.ndarray, y: np.ndarray, watch: int, trees: int, depth: int, rate: float, bins: int, patience: int) -> Boosted:
    """The last `watch` rows choose the number of trees; the model is then fitted to all rows."""
    if len(y) - watch < 2:
        return fit(x, y, 0)
    first = fit(x[:-watch], y[:-watch], trees, depth, rate, bins, (x[-watch:], y[-watch:]), patience)
    return fit(x, y, len(first.trees), depth, rate, bins)
