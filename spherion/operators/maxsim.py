"""Late interaction (MaxSim): exact scores, coarse candidates from 1-bit codes, exact reranking, top-k.

A document is an array of token vectors.  distance(document, query) = sum over query tokens of the least -dot over the
document's tokens; the right operand is the query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spherion.functions import rabitq
from spherion.functions.kernels import half, maxsim
from spherion.operators.ivf import IvfIndex

MAX_TOKENS, MAX_CANDIDATES = 65536, 65536
BACKENDS = ("coarse_only", "cpu_exact", "gpu", "auto")


def checked_tensor(rows, dim: int | None = None) -> np.ndarray:
    """A token matrix; errors as the operators raise them."""
    if rows is None or len(rows) == 0:
        raise ValueError("multi-vector must not be empty")
    if len(rows) > MAX_TOKENS:
        raise ValueError(f"multi-vector must not have more than {MAX_TOKENS} vectors")
    if any(r is None for r in rows):
        raise ValueError("multi-vector must not contain NULL")
    if len({len(r) for r in rows}) != 1 or (dim is not None and len(rows[0]) != dim):
        raise ValueError("dimension is not matched")
    return np.asarray(rows, np.float64)


def maxsim_distance(document: Column | str, query: Column | str) -> Column:
    """As a Catalyst expression; null for a null operand."""
    d = F.col(document) if isinstance(document, str) else document
    q = F.col(query) if isinstance(query, str) else query
    d, q = d.cast("array<array<double>>"), q.cast("array<array<double>>")

    def dot(x: Column, y: Column) -> Column:
        error = F.raise_error(F.lit("dimension is not matched")).cast("double")
        return F.when(F.size(x) == F.size(y), F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).otherwise(error)

    score = F.aggregate(q, F.lit(0.0), lambda s, t: s + F.array_max(F.transform(d, lambda u: dot(u, t))))
    bad = (F.size(d) == 0) | (F.size(q) == 0) | F.exists(d, lambda t: t.isNull()) | F.exists(q, lambda t: t.isNull())
    error = F.raise_error(F.lit("multi-vector must not be empty or contain NULL")).cast("double")
    return F.when(d.isNull() | q.isNull(), F.lit(None).cast("double")).when(bad, error).otherwise(-score)


def _tensors(column: pa.Array) -> list[np.ndarray | None]:
    """Token matrices of an array<array<float>> column without a Python object per number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = []
    for item in column:
        if not item.is_valid:
            out.append(None)
            continue
        tokens = item.values
        if len(tokens) == 0:
            raise ValueError("multi-vector must not be empty")
        if tokens.null_count:
            raise ValueError("multi-vector must not contain NULL")
        sizes = tokens.value_lengths().to_numpy()
        if (sizes != sizes[0]).any():
            raise ValueError("dimension is not matched")
        out.append(tokens.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(tokens), -1))
    return out


def exact_scores(docs: DataFrame, query, id_col: str = "doc_id", tensor_col: str = "tokens", to_half: bool = False) -> DataFrame:
    """(id, distance) of every document, by one matrix product each in Arrow batches; null tensors are skipped."""
    q = checked_tensor(query)
    q = half(q) if to_half else q

    def run(batches):
        for batch in batches:
            ids, scores = [], []
            for key, d in zip(batch.column(0).to_pylist(), _tensors(batch.column(1))):
                if d is not None:
                    if d.shape[1] != q.shape[1]:
                        raise ValueError("dimension is not matched")
                    ids.append(key)
                    scores.append(maxsim(half(d) if to_half else d, q))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["id", "distance"])

    return docs.select(F.col(id_col).cast("long").alias("id"), tensor_col).mapInArrow(run, "id long, distance double")


def maxsim_top_k(docs: DataFrame, query, k: int, **names) -> DataFrame:
    return exact_scores(docs, query, **names).orderBy("distance", "id").limit(k)


def rerank_ids(docs: DataFrame, query, candidate_ids: list[int], k: int, id_col: str = "doc_id", tensor_col: str = "tokens") -> DataFrame:
    """(public_id, similarity) of a given set of ids; ids without a row drop out."""
    if not candidate_ids or any(i is None for i in candidate_ids) or len(set(candidate_ids)) < len(candidate_ids):
        raise ValueError("candidate ids must not be empty, NULL or repeated")
    if not 1 <= k <= len(candidate_ids):
        raise ValueError("top_k must be from 1 to the number of candidate ids")
    ids = docs.sparkSession.createDataFrame([(int(i),) for i in candidate_ids], "__id long")
    chosen = docs.join(ids, docs[id_col] == ids["__id"], "left_semi")
    scored = exact_scores(chosen, query, id_col, tensor_col)
    return scored.select(F.col("id").alias("public_id"), (-F.col("distance")).alias("similarity")).orderBy(F.desc("similarity"), "public_id").limit(k)


@dataclass(frozen=True)
class CoarseOptions:
    """``refine``: nearest estimates of each query token that are scored exactly.  ``threshold``: tokens that a query token's lists
    must cover before the last list's distance bounds what it did not visit.  ``candidate_limit``: documents kept (-1: all)."""

    refine: int = 0
    threshold: int = 0
    candidate_limit: int = -1
    backend: str = "coarse_only"

    def checked(self) -> "CoarseOptions":
        if self.backend not in BACKENDS:
            raise ValueError(f"backend must be one of {', '.join(BACKENDS)}")
        if self.backend != "coarse_only" and self.candidate_limit <= 0:
            raise ValueError("an exact backend needs candidate_limit > 0")
        if self.refine < 0 or self.threshold < 0 or self.candidate_limit > MAX_CANDIDATES:
            raise ValueError("option out of range")
        return self


#: Numbers of a block of tokens, and nearest tokens that a task holds before it passes some on.
BLOCK_NUMBERS, HELD_TOKENS = 1 << 21, 1 << 18
#: Dimensions up to which tokens are rotated by a matrix.
MATRIX_DIM = 1024


def _token_blocks(batches, dim: int):
    """(document ids, first token of each, id and position of each token, token matrix) of whole documents in small blocks."""
    for batch in batches:
        keys, held, numbers = [], [], 0
        tensors = list(zip(batch.column(0).to_pylist(), _tensors(batch.column(1))))
        for at, (key, d) in enumerate(tensors):
            if d is not None:
                if d.shape[1] != dim:
                    raise ValueError("dimension is not matched")
                keys.append(key)
                held.append(d)
                numbers += d.size
            if held and (numbers >= BLOCK_NUMBERS or at == len(tensors) - 1):
                ids, sizes = np.array(keys, np.int64), np.array([len(d) for d in held])
                first = np.cumsum(sizes) - sizes
                yield ids, first, np.repeat(ids, sizes), (np.arange(sizes.sum()) - np.repeat(first, sizes)).astype(np.int32), np.vstack(held)
                keys, held, numbers = [], [], 0


def _rough(rotated: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Estimated token distances, a row per query token."""
    turned = x @ rabitq.rotation(x.shape[1]) if x.shape[1] <= MATRIX_DIM else rabitq.rotate(x)
    return -rabitq.binary_products(*rabitq.binary_code(turned), rotated)


def _nearest_tokens(rotated: np.ndarray, refine: int):
    """A task's ``refine`` nearest tokens of each query token by estimate."""

    def nearest(rows):
        q, rough, ids, pos = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((pos, ids, rough, q))
        first = np.searchsorted(q[order], np.arange(len(rotated)))
        best = order[np.arange(len(order)) - first[q[order]] < refine]
        return q[best], rough[best], ids[best], pos[best]

    def packed(columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "rough", "id", "pos"])

    def run(batches):
        rows, waiting = [], 0
        for _, _, ids, pos, x in _token_blocks(batches, rotated.shape[1]):
            n, rough = len(ids), _rough(rotated, x)
            rows.append((np.repeat(np.arange(len(rough), dtype=np.int32), n), rough.ravel(), np.tile(ids, len(rough)), np.tile(pos, len(rough))))
            waiting += rough.size
            if waiting > HELD_TOKENS:
                rows = [nearest(rows)]
                waiting = len(rows[0][0])
                if waiting > HELD_TOKENS // 2:
                    yield packed(rows[0])
                    rows, waiting = [], 0
        if rows:
            yield packed(nearest(rows))

    return run


def _cuts(tokens: DataFrame, refine: int) -> DataFrame:
    """(q, cut): the last (rough, id, pos) of each query token that is among its ``refine`` nearest; a row per query token."""

    def nearest(rows: DataFrame, *by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("rough", "id", "pos"))
        return rows.withColumn("r", rank).where(F.col("r") <= refine).drop("r")

    dealt = tokens.select("q", "rough", "id", "pos", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part"))
    return nearest(nearest(dealt, "q", "part"), "q").groupBy("q").agg(F.max(F.struct("rough", "id", "pos")).alias("cut"))


def _document_estimates(q: np.ndarray, rotated: np.ndarray, cuts: dict[int, tuple]):
    def run(batches):
        for keys, first, ids, pos, x in _token_blocks(batches, q.shape[1]):
            rough = _rough(rotated, x)
            for k, (r, key, p) in cuts.items():
                at = np.flatnonzero((rough[k] < r) | ((rough[k] == r) & ((ids < key) | ((ids == key) & (pos <= p)))))
                rough[k, at] = -(x[at] @ q[k])
            score = np.minimum.reduceat(rough, first, axis=1).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(score)], ["id", "estimate"])

    return run


def _limited(found: DataFrame, limit: int) -> DataFrame:
    out = found.orderBy("estimate", "id")
    return out if limit < 0 else out.limit(limit)


def coarse_candidates(docs: DataFrame, query, options: CoarseOptions = CoarseOptions(), id_col: str = "doc_id", tensor_col: str = "tokens") -> DataFrame:
    """(id, estimate): the order of documents that 1-bit codes of all tokens estimate.

    A document is scored where it is read, without a shuffle; with ``refine`` a first pass finds how near a token must be
    to each query token to be scored exactly.  Null tensors and null ids are skipped; a repeated id is scored each time.
    """
    options = options.checked()
    q = checked_tensor(query)
    rotated = rabitq.rotate(q)
    given = docs.select(F.col(id_col).cast("long").alias("id"), tensor_col).where("id is not null")
    cuts = {}
    if options.refine:
        nearest = given.mapInArrow(_nearest_tokens(rotated, options.refine), "q int, rough double, id long, pos int")
        cuts = {r["q"]: tuple(r["cut"]) for r in _cuts(nearest, options.refine).collect()}
    return _limited(given.mapInArrow(_document_estimates(q, rotated, cuts), "id long, estimate double"), options.candidate_limit)


def _page_scores(tokens: DataFrame, options: CoarseOptions, bounds: list[float]) -> DataFrame:
    """(id, estimate) from the token distances (id, pos, q, rough, exact) of visited tokens.

    The ``refine`` best of each query token become exact; a document keeps its least distance per query token.  A missing
    cell is the greater of the query token's worst visited distance and its bound, or 0 if it visited nothing.
    """
    if options.refine:
        near = F.struct("rough", "id", "pos") <= F.col("cut")
        refined = F.when(near, F.col("exact")).otherwise(F.col("rough"))
        tokens = tokens.join(F.broadcast(_cuts(tokens, options.refine)), "q").select("id", "q", refined.alias("rough"))
    cells = tokens.groupBy("id", "q").agg(F.min("rough").alias("d"))
    known = F.element_at(F.array(*[F.lit(float(b)) for b in bounds]), F.col("q") + 1)
    gaps = tokens.groupBy("q").agg(F.greatest(F.max("rough"), known).alias("w"))
    all_gaps = gaps.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("all"))
    total = cells.join(F.broadcast(gaps), "q").groupBy("id").agg(F.sum(F.col("d") - F.col("w")).alias("d"))
    total = total.join(F.broadcast(all_gaps)).select("id", (F.col("d") + F.col("all")).alias("estimate"))
    return _limited(total, options.candidate_limit)


def token_rows(docs: DataFrame, id_col: str = "doc_id", tensor_col: str = "tokens") -> DataFrame:
    """(vec_id, embedding): a row per token, its id the document's times 65536 plus its position; for an inverted file."""
    t = docs.select(F.col(id_col).cast("long").alias("id"), F.posexplode(tensor_col).alias("pos", "embedding"))
    return t.select((F.col("id") * MAX_TOKENS + F.col("pos")).alias("vec_id"), "embedding")


def indexed_candidates(index: IvfIndex, query, probes: str | list[int], options: CoarseOptions = CoarseOptions()) -> DataFrame:
    """(id, estimate) from an inverted file of ``token_rows`` (metric ip): each query token visits its own probed lists.

    With ``threshold`` the lists are walked on in order of distance until they cover that many tokens; the distance of the
    last one bounds what was not visited.
    """
    options = options.checked()
    q = checked_tensor(query, index.dim)
    lists = [index.probed_lists(t, probes) for t in q]
    leaves, spread = index.levels[-1][0], index.options.residual_quantization
    bounds = [float("-inf")] * len(q)
    if options.threshold:
        sizes = {r["list_id"]: r["n"] for r in index.rows().groupBy("list_id").agg(F.count("*").alias("n")).collect()}
        for k, t in enumerate(q):
            covered = sum(sizes.get(x, 0) for x in lists[k])
            for leaf in np.argsort(-(leaves @ t), kind="stable"):
                if covered >= options.threshold:
                    break
                if int(leaf) not in lists[k]:
                    covered += sizes.get(int(leaf), 0)
                    bounds[k] = float(-(leaves[leaf] @ t))
    rotated = rabitq.rotate(q)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, of = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(len(ids), -1)
            signs = np.unpackbits(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(ids), -1), axis=1, bitorder="little")[:, : x.shape[1]].astype(bool)
            factors = {f: batch.column(batch.schema.get_field_index(f)).to_numpy() for f in ("dis_u_2", "factor_ip", "factor_err")}
            for k, t in enumerate(rotated):
                at = np.flatnonzero(np.isin(of, lists[k]))
                rough = rabitq.binary_estimate("ip", signs[at], {f: v[at] for f, v in factors.items()}, t)[0] - (leaves[of[at]] @ q[k] if spread else 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at] // MAX_TOKENS), pa.array((ids[at] % MAX_TOKENS).astype(np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(rough), pa.array(-(x[at] @ q[k]))], ["id", "pos", "q", "rough", "exact"])

    rows = index.rows().where(F.col("list_id").isin(sorted({x for own in lists for x in own})))
    return _page_scores(rows.mapInArrow(run, "id long, pos int, q int, rough double, exact double"), options, bounds)


def maxsim_search(
    docs: DataFrame, query, k: int, options: CoarseOptions = CoarseOptions(), id_col: str = "doc_id", tensor_col: str = "tokens", index: IvfIndex | None = None, probes: str | list[int] | None = None
) -> DataFrame:
    """(id, distance): candidates, then, unless the backend is coarse_only, exact reranking of them.

    Candidates come from all tokens, or from the ``probes`` of an ``index`` over ``token_rows(docs)``.
    There is no GPU: ``gpu`` and ``auto`` score on the executors with the same result.
    """
    if index is not None and probes is None:
        raise ValueError("a search through an index needs probes")
    found = coarse_candidates(docs, query, options, id_col, tensor_col) if index is None else indexed_candidates(index, query, probes, options)
    if options.backend == "coarse_only":
        return found.select("id", F.col("estimate").alias("distance")).orderBy("distance", "id").limit(k)
    chosen = docs.join(found.select(F.col("id").alias("__id")), docs[id_col] == F.col("__id"), "left_semi")
    return exact_scores(chosen, query, id_col, tensor_col).orderBy("distance", "id").limit(k)


def merge_top_k(parts: list[list[tuple[float, int]]], k: int) -> list[tuple[float, int]]:
    """The k smallest (distance, id) of several lists."""
    import heapq

    return heapq.nsmallest(k, (x for p in parts for x in p))


def profiled_search(docs: DataFrame, query, k: int, options: CoarseOptions = CoarseOptions(), id_col: str = "doc_id", tensor_col: str = "tokens") -> tuple[list[tuple[int, float]], dict]:
    """(result, profile): rows (id, distance), and counts and milliseconds of the stages."""
    import time

    def timed(f):
        start = time.perf_counter()
        out = f()
        return out, round(1000 * (time.perf_counter() - start), 3)

    size, size_ms = timed(lambda: docs.where(F.col(tensor_col).isNotNull()).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(tensor_col)), F.lit(0)).alias("t")).first())
    found, candidate_ms = timed(lambda: coarse_candidates(docs, query, options, id_col, tensor_col).count())
    rows, search_ms = timed(lambda: [tuple(r) for r in maxsim_search(docs, query, k, options, id_col, tensor_col).collect()])
    return rows, {"backend": options.backend, "query_tokens": len(query), "documents": size["n"], "document_tokens": size["t"], "candidates": found, "returned": len(rows), "scan_ms": size_ms, "candidate_ms": candidate_ms, "search_ms": search_ms}
