"""Pairs that meet in buckets, found in numpy blocks, without one task ever holding a hot bucket whole.

Rows are (cell, role, item): ``cell`` names a bucket, ``role`` is BOTH (may be found and
looks for others), PROBE (only looks) or RESIDENT (is only found).  ``spread_hot`` deals buckets above a
size over a grid of cells, so that every pair still meets in some cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOTH, PROBE, RESIDENT = 0, 1, 2


def spread_hot(rows: DataFrame, hot: DataFrame, item: Column, cap: int) -> DataFrame:
    """Adds ``salt``.  ``hot`` (cell, n_hot) lists the buckets above ``cap``; n_hot counts their rows.

    A hot bucket becomes a grid of g x g cells, g = ceil(n_hot / cap): whoever may be found goes to one
    grid row, whoever looks goes to one grid column, and each cell holds about ``cap`` of either.
    """
    h = hot.select(F.col("cell").alias("__cell"), F.ceil(F.col("n_hot") / F.lit(cap)).cast("int").alias("__g"))
    joined = rows.join(h, rows["cell"] == h["__cell"], "left").drop("__cell")
    line = F.sequence(F.lit(0), F.col("__g") - 1)
    own = F.pmod(F.xxhash64(item), F.col("__g")).cast("int")
    found = F.transform(line, lambda p: F.struct(F.lit(RESIDENT).alias("role"), (own * F.col("__g") + p).alias("salt")))
    looks = F.transform(line, lambda r: F.struct(F.lit(PROBE).alias("role"), (r * F.col("__g") + own).alias("salt")))
    cells = (
        F.when(F.col("__g").isNull(), F.array(F.struct(F.col("role").cast("int").alias("role"), F.lit(0).alias("salt"))))
        .when(F.col("role") == BOTH, F.concat(found, looks))
        .when(F.col("role") == PROBE, looks)
        .otherwise(found)
    )
    others = [c for c in rows.columns if c not in ("role", "salt")]
    return joined.select(*others, F.inline(cells))


def partner_ranges(cell: np.ndarray, salt: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, lo, hi): in ``order``, row i looks at the rows lo[i] to hi[i] - 1, each unordered pair of BOTH rows once."""
    rank = np.where(role == PROBE, 1, 0)
    order = np.lexsort((rank, salt, cell))
    c, s, k, r = cell[order], salt[order], rank[order], role[order]
    n = len(order)
    new = np.ones(n, bool)
    new[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    residents = np.bincount(group, weights=(k == 0), minlength=len(start)).astype(np.int64)
    end = (start + residents)[group] if n else np.zeros(0, np.int64)
    lo = np.where(r == BOTH, np.arange(n) + 1, start[group] if n else 0)
    hi = np.where(r == RESIDENT, lo, end)
    return order, lo, np.maximum(hi, lo)


def expand(lo: np.ndarray, hi: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), lo[i] <= j < hi[i], in blocks of about ``budget``."""
    count = hi - lo
    rows = np.flatnonzero(count)
    total = np.cumsum(count[rows])
    at = 0
    while at < len(rows):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + budget, "right")))
        own = rows[at:to]
        n = count[own]
        i = np.repeat(own, n)
        first = np.cumsum(n) - n
        j = np.arange(len(i)) - np.repeat(first, n) + np.repeat(lo[own], n)
        yield i, j
        at = to


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) that join what the edges (u, v) join: at most one per vertex."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(names))
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]
