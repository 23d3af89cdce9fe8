"""Gradient-boosted trees over small numeric features, fitted on rows or on counts of equal rows."""

from __future__ import annotations

import numpy as np

TREES = 40
DEPTH = 3
RATE = 0.25
BINS = 24
LEAST_ROWS = 5
RIDGE = 1.0


class Boosted:
    """Logistic boosting with depth-limited trees on quantile bins."""

    def __init__(self) -> None:
        self.base = 0.0
        self.trees: list[list[tuple[int, float, float]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> Boosted:
        """``x`` (rows, features) and labels ``y`` of 0 and 1, both of which occur; a row counts ``times``."""
        if times is None:
            share, times = y.mean(), np.ones(len(y))
            edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        else:
            share = np.average(y, weights=times)
            edges = [_quantiles(c, times) for c in x.T]
        self.base = float(np.log(share / (1 - share)))
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
        margin = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, edges, times * (p - y), times * p * (1 - p), times)
            self.trees.append(tree)
            margin += self._values(tree, x)
        return self

    @staticmethod
    def _grow(binned, edges, slope, bend, times) -> list[tuple[int, float, float]]:
        """A complete tree as (feature, bound, value) by heap position; feature -1 is a leaf."""
        tree = [(-1, 0.0, 0.0)] * ((2 << DEPTH) - 1)
        todo = [(0, np.arange(len(slope)))]
        for node, rows in todo:
            g, h, total = slope[rows].sum(), bend[rows].sum(), times[rows].sum()
            best = (1e-6, -1, 0.0)
            if node < (1 << DEPTH) - 1 and total >= 2 * LEAST_ROWS:
                for f, bounds in enumerate(edges):
                    if not len(bounds):
                        continue
                    at = binned[f, rows]
                    left_g = np.cumsum(np.bincount(at, slope[rows], len(bounds) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(at, bend[rows], len(bounds) + 1))[:-1]
                    count = np.cumsum(np.bincount(at, times[rows], len(bounds) + 1))[:-1]
                    gain = left_g**2 / (left_h + RIDGE) + (g - left_g) ** 2 / (h - left_h + RIDGE) - g**2 / (h + RIDGE)
                    gain[(count < LEAST_ROWS) | (total - count < LEAST_ROWS)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, float(bounds[k]))
            _, f, bound = best
            tree[node] = (f, bound, float(-RATE * g / (h + RIDGE)))
            if f >= 0:
                low = binned[f, rows] <= int(np.searchsorted(edges[f], bound))
                todo += [(2 * node + 1, rows[low]), (2 * node + 2, rows[~low])]
        return tree

    @staticmethod
    def _values(tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        feature, bound, value = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(DEPTH):
            f = feature[at]
            down = 2 * at + 1 + (x[rows, np.maximum(f, 0)] > bound[at])
            at = np.where(f < 0, at, down)
        return value[at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for tree in self.trees:
            margin += self._values(tree, x)
        return 1 / (1 + np.exp(-margin))


def _quantiles(values: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The distinct quantiles that cut ``values``, each there so many ``times``, into ``BINS`` bins.

    Between two values the quantile lies in proportion, as ``np.quantile`` has it for rows.
    """
    order = np.argsort(values, kind="stable")
    values, ends = values[order], np.cumsum(times[order])
    place = np.linspace(0, 1, BINS + 1)[1:-1] * (ends[-1] - 1)
    low = values[np.searchsorted(ends, np.floor(place), side="right")]
    high = values[np.searchsorted(ends, np.ceil(place), side="right")]
    return np.unique(low + (high - low) * (place - np.floor(place)))
