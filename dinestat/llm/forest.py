"""An isolation forest in numpy: random splits isolate anomalies after few of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EULER = 0.5772156649


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.maximum(np.asarray(n, float), 1.0)
    full = 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / n
    return np.where(n > 2, full, n - 1)


@dataclass
class Forest:
    """Trees as arrays: node i of a tree has children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x nodes; -1 at leaves
    cut: np.ndarray
    length: np.ndarray  # path length of a point that ends at the node
    scale: float

    def score(self, points: np.ndarray) -> np.ndarray:
        """Anomaly scores between 0 and 1; above one half are the easily isolated."""
        total, rows = np.zeros(len(points)), np.arange(len(points))
        for feature, cut, length in zip(self.feature, self.cut, self.length, strict=True):
            at = np.zeros(len(points), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = points[rows, f] >= cut[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += length[at]
        return 2.0 ** (-total / (len(self.feature) * self.scale))


def depth_of(size: int) -> int:
    """Splits after which a tree on ``size`` points stops."""
    return max(1, int(np.ceil(np.log2(max(size, 2)))))


def grow_tree(points: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """Features, cuts and path lengths of one tree's nodes, on all the points given."""
    nodes = 2 ** (depth + 1) - 1
    feature, cut, length = np.full(nodes, -1, np.int64), np.zeros(nodes), np.zeros(nodes)
    todo = [(0, 0, points)]
    while todo:
        node, level, own = todo.pop()
        low, high = own.min(axis=0), own.max(axis=0)
        varied = np.flatnonzero(high > low)
        if level == depth or len(own) < 2 or not len(varied):
            length[node] = level + float(expected_path(len(own)))
            continue
        f = rng.choice(varied)
        feature[node], cut[node] = f, rng.uniform(low[f], high[f])
        right = own[:, f] >= cut[node]
        todo += [(2 * node + 1, level + 1, own[~right]), (2 * node + 2, level + 1, own[right])]
    return feature, cut, length


def grow(points: np.ndarray, trees: int, sample: int, seed: int = 7) -> Forest:
    """A forest on ``points``, each tree on ``sample`` of them without replacement."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(points))
    grown = [
        grow_tree(points[rng.choice(len(points), size, replace=False)], depth_of(size), rng)
        for _ in range(trees)
    ]
    return Forest(*map(np.array, zip(*grown, strict=True)), float(expected_path(size)))
