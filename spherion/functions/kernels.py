"""numpy kernels behind the Arrow-batched operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): which rows of a list column are not null, and their values as a double matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False))
    sizes = column.value_lengths().drop_null().to_numpy(zero_copy_only=False)
    if not len(sizes):
        return rows, np.zeros((0, dim or 0))
    dim = int(sizes[0]) if dim is None else dim
    if (sizes != dim).any():
        raise ValueError("dimension is not matched")
    return rows, column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A row per query: distances to each row of ``x``, l2 exact to rounding near zero."""
    inner = q @ x.T
    if metric == "ip":
        return -inner
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - inner / np.sqrt((q * q).sum(1)[:, None] * (x * x).sum(1))
    square = (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * inner
    near = np.argwhere(square < 1e-6 * ((q * q).sum(1)[:, None] + (x * x).sum(1)))
    square[near[:, 0], near[:, 1]] = ((q[near[:, 0]] - x[near[:, 1]]) ** 2).sum(1)
    return np.sqrt(square)


def least(distance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest entries of a row, ties by id; NaN last."""
    if len(distance) > 4 * k:
        edge = np.partition(distance, k - 1)[k - 1]
        keep = np.flatnonzero(~(distance > edge)) if not np.isnan(edge) else np.arange(len(distance))
    else:
        keep = np.arange(len(distance))
    return keep[np.lexsort((ids[keep], distance[keep]))[:k]]


def maxsim(document: np.ndarray, query: np.ndarray) -> float:
    """Sum over query tokens of the least -dot over document tokens."""
    return float(-(query @ document.T).max(1).sum())


def half(x: np.ndarray) -> np.ndarray:
    """Rounded to IEEE half precision."""
    return x.astype("<f2").astype(np.float64)
