"""k-means on a bounded sample, on the driver: Lloyd, hierarchical, in fewer dimensions, spherical."""

from __future__ import annotations

import warnings

import numpy as np

from spherion.functions.rabitq import rotate

#: Relative shift that parts an empty cluster from the largest.
SHIFT = 9.77e-4


def assign(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Nearest centroid of each row; of equally near ones the later."""
    out = np.empty(len(x), np.int64)
    square = (centroids * centroids).sum(1)
    for at in range(0, len(x), 8192):
        part = square - 2 * (x[at : at + 8192] @ centroids.T)
        out[at : at + 8192] = len(centroids) - 1 - part[:, ::-1].argmin(1)
    return out


def _spherical(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-30)


def lloyd(x: np.ndarray, k: int, iterations: int = 10, spherical: bool = False, seed: int = 0) -> np.ndarray:
    """k centroids.  With no more rows than k they are the rows, filled up with noise from (-1, 1)."""
    r = np.random.default_rng(seed)
    if len(x) <= k:
        out = np.vstack([x, r.uniform(-1, 1, (k - len(x), x.shape[1]))])
        return _spherical(out) if spherical else out
    centroids = x[r.choice(len(x), k, replace=False)].copy()
    for _ in range(iterations):
        label = assign(x, centroids)
        count = np.bincount(label, minlength=k).astype(np.float64)
        total = np.zeros_like(centroids)
        np.add.at(total, label, x)
        full = count > 0
        centroids[full] = total[full] / count[full, None]
        for empty in np.flatnonzero(~full):
            largest = int(count.argmax())
            sign = np.where(np.arange(x.shape[1]) % 2 == 0, 1 + SHIFT, 1 - SHIFT)
            centroids[empty], centroids[largest] = centroids[largest] * sign, centroids[largest] * (2 - sign)
            count[empty] = count[largest] = count[largest] / 2
        if spherical:
            centroids = _spherical(centroids)
    return centroids


def seats(sizes: np.ndarray, total: int) -> np.ndarray:
    """``total`` seats dealt to groups by size, one at least each where possible (highest averages, first divisor 1.4)."""
    out = np.zeros(len(sizes), np.int64)
    for _ in range(total):
        out[int((sizes / np.where(out == 0, 1.4, 2 * out + 1)).argmax())] += 1
    return out


def hierarchical(x: np.ndarray, k: int, iterations: int = 10, spherical: bool = False, seed: int = 0) -> np.ndarray:
    """About sqrt(k) coarse clusters, each split into its share of k."""
    coarse = lloyd(x, max(1, int(np.sqrt(k))), iterations, spherical, seed)
    label = assign(x, coarse)
    share = seats(np.bincount(label, minlength=len(coarse)).astype(float), k)
    return np.vstack([lloyd(x[label == g], int(n), iterations, spherical, seed + g) for g, n in enumerate(share) if n])


def train(x: np.ndarray, k: int, iterations: int = 10, spherical: bool = False, dimension: int | None = None, algorithm: str = "lloyd", seed: int = 0) -> np.ndarray:
    """``dimension``: cluster rotated vectors cut to it, then average the full vectors."""
    run = {"lloyd": lloyd, "hierarchical": hierarchical}[algorithm]
    if dimension is not None and dimension >= x.shape[1]:
        warnings.warn("kmeans_dimension is not below the dimension and is ignored", stacklevel=2)
        dimension = None
    if dimension is None or len(x) <= k:
        return run(x, k, iterations, spherical, seed)
    short = rotate(x)[:, :dimension]
    label = assign(short, run(short, k, iterations, spherical, seed))
    out = np.zeros((k, x.shape[1]))
    np.add.at(out, label, x)
    out /= np.maximum(np.bincount(label, minlength=k), 1)[:, None]
    return _spherical(out) if spherical else out
