"""A random forest for two classes, small enough to broadcast: numpy arrays, no other library."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.share[at]


def _best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """(impurity, feature, threshold) of the split with the least Gini impurity that leaves ``least`` rows on each side."""
    best = None
    n, ones = len(y), y.sum()
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[:-1] < v[1:])
        cut = cut[(cut + 1 >= least) & (n - cut - 1 >= least)]
        if not len(cut):
            continue
        m, p = cut + 1.0, c[cut].astype(float)
        q = ones - p
        impurity = 2 * p * (1 - p / m) + 2 * q * (1 - q / (n - m))
        i = int(np.argmin(impurity))
        if best is None or impurity[i] < best[0]:
            best = (float(impurity[i]), int(f), float((v[cut[i]] + v[cut[i] + 1]) / 2))
    return best


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, tried: int) -> Tree:
    nodes: list[list] = []

    def add(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        share = float(y[rows].mean())
        nodes.append([-1, 0.0, -1, -1, share])
        if level < depth and 0 < share < 1:
            split = _best_split(x[rows], y[rows], rng.permutation(x.shape[1])[:tried], least)
            if split:
                low = x[rows, split[1]] <= split[2]
                nodes[me][:2] = split[1], split[2]
                nodes[me][2] = add(rows[low], level + 1)
                nodes[me][3] = add(rows[~low], level + 1)
        return me

    add(rng.integers(0, len(y), len(y)), 0)
    return Tree(*(np.array(column) for column in zip(*nodes)))


class Forest:
    """``trees`` trees, each grown on a bootstrap sample with a random choice of features at each split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 7):
        rng = np.random.default_rng(seed)
        tried = max(1, round(x.shape[-1] ** 0.5) + 1)
        self.trees = [_grow(x, y.astype(np.int64), rng, depth, least, tried) for _ in range(trees)] if len(y) else []

    def score(self, x: np.ndarray) -> np.ndarray:
        """The mean share of positives in the leaves that each row reaches; 0 without trees."""
        if not len(x) or not self.trees:
            return np.zeros(len(x))
        return np.mean([t.predict(x) for t in self.trees], axis=0)
