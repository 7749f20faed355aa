"""Exact search: top-k, range, and the k nearest per row of a query table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spherion.functions import distance as D
from spherion.functions.kernels import distances, half, least, matrix

#: Bytes of query vectors that are sent to every task; larger query tables are dealt over a grid, whose cells hold as much
#: of them and BASE_BYTES of the vectors they are compared with.
QUERY_BYTES, BASE_BYTES = 32 << 20, 256 << 20
#: Distances that a task holds at once.
BLOCK = 4 << 20


def _query(query) -> Column | None:
    return query if isinstance(query, Column) or query is None else D.vector(query)


def top_k(df: DataFrame, query, k: int, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding", where: Column | None = None, max_scan: int = -1) -> DataFrame:
    """(all columns, distance) of the k nearest rows, ties by id; null vectors are skipped, a null query finds nothing.

    ``where`` filters first.  ``max_scan`` caps the rows that the search emits before ``where`` (-1: no cap).
    """
    rows = df.where(F.col(vec_col).isNotNull())
    if query is None:
        return rows.withColumn("distance", F.lit(None).cast("double")).where(F.lit(False))
    if where is not None and max_scan < 0:
        rows = rows.where(where)
    rows = rows.withColumn("distance", D.distance(metric, vec_col, _query(query)))
    if max_scan >= 0:
        rows = rows.orderBy(F.asc_nulls_last("distance"), id_col).limit(max_scan)
        rows = rows if where is None else rows.where(where)
    return rows.orderBy(F.asc_nulls_last("distance"), id_col).limit(k)


def range_search(df: DataFrame, query, radius: float, metric: str = "l2", vec_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """Rows strictly inside the sphere."""
    rows = df.where(F.col(vec_col).isNotNull())
    rows = rows if where is None else rows.where(where)
    rows = rows.withColumn("distance", D.distance(metric, vec_col, _query(query)))
    return rows.where(F.col("distance") < F.lit(float(radius)))


def top_k_per_group(df: DataFrame, group: str, query, k: int, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest of each group (a window with a group limit, so each task sends k rows a group at most)."""
    rows = df.where(F.col(vec_col).isNotNull()).withColumn("distance", D.distance(metric, vec_col, _query(query)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("distance", id_col))).where(F.col("rank") <= k)


_PAIRS = "query_id long, neighbor_id long, distance double"


def _best(ids, rows_id, d, k, exclude_self):
    out = ([], [], [])
    for i, q in enumerate(ids):
        row = d[i]
        if exclude_self:
            row = np.where(rows_id == q, np.nan, row)
        pick = least(row, rows_id, k)
        pick = pick[~(exclude_self & (rows_id[pick] == q))] if exclude_self else pick
        out[0].append(np.full(len(pick), q))
        out[1].append(rows_id[pick])
        out[2].append(row[pick])
    joined = [np.concatenate(x) if x else np.zeros(0) for x in out]
    return pa.RecordBatch.from_arrays([pa.array(joined[0].astype(np.int64)), pa.array(joined[1].astype(np.int64)), pa.array(joined[2].astype(np.float64))], ["query_id", "neighbor_id", "distance"])


def _scorer(metric, ids, q, k, exclude_self, to_half):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, x = matrix(batch.column(1), q.shape[1])
            x = half(x) if to_half else x
            names, step = batch.column(0).to_numpy()[rows], max(BLOCK // max(len(x), 1), 1)
            for at in range(0, len(q), step):
                yield _best(ids[at : at + step], names, distances(metric, q[at : at + step], x), k, exclude_self)

    return run


def knn_join(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding", exclude_self: bool = False, to_half: bool = False) -> DataFrame:
    """(query_id, neighbor_id, distance, rank): the k nearest rows of ``base`` for each row of ``queries``.

    Queries of at most QUERY_BYTES go to every task, which returns k rows a query and batch; more are dealt over a grid
    with ``base``, whose sides follow from the bytes of either, so no task holds more than a block of both.
    """
    q = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    b = base.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))

    def vector_bytes(df: DataFrame) -> int:
        return df.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("n")).first()["n"] * 8

    size = vector_bytes(q)
    if size <= QUERY_BYTES:
        table = q.toArrow()
        _, x = matrix(table.column(1)) if table.num_rows else (None, np.zeros((0, 0)))
        if not len(x):
            pairs = b.sparkSession.createDataFrame([], _PAIRS)
        else:
            pairs = b.mapInArrow(_scorer(metric, table.column(0).to_numpy(), half(x) if to_half else x, k, exclude_self, to_half), _PAIRS)
    else:
        rows, columns = -(-size // QUERY_BYTES), max(-(-vector_bytes(b) // BASE_BYTES), 1)

        def dealt(df: DataFrame, own: str, over: int, other: str, copies: int) -> DataFrame:
            # Both sides' keys must be of one type: cogroup deals each side by the hash of its own type.
            return df.withColumn(own, F.pmod(F.xxhash64("id", F.lit(own)), F.lit(over)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

        left, right = dealt(q, "g", rows, "c", columns), dealt(b, "c", columns, "g", rows)

        def cell(l: pa.Table, r: pa.Table) -> pa.Table:
            if not l.num_rows or not r.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "neighbor_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
            _, x = matrix(l.column("v"))
            run = _scorer(metric, l.column("id").to_numpy(), half(x) if to_half else x, k, exclude_self, to_half)
            return pa.Table.from_batches(run(r.select(["id", "v"]).to_batches(max_chunksize=8192)))

        pairs = left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInArrow(cell, _PAIRS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
