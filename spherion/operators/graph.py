"""Proximity graphs: one Vamana-style graph per partition, beam search in each, merged top-k."""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spherion.functions import rabitq
from spherion.functions.kernels import least, matrix

MAX_DIMENSION = 30000
#: Rows of a graph: one task builds it, and a beam of a given width finds less in larger ones.
NODES = 1250
#: Bytes of queries that tasks get at once, and queries whose results they give at once.
QUERY_BYTES, ANSWERS = 16 << 20, 1024
#: Numbers that pruning holds at once.
PAIRS = 1 << 20
_FOUND = "query_id long, id long, distance double"


@dataclass(frozen=True)
class GraphOptions:
    """``bits``: 1 or 2 per dimension in codes; ``m``: most neighbours; ``alpha``: pruning slack (L2 and cosine)."""

    metric: str = "l2"
    bits: int = 2
    m: int = 32
    alpha: tuple[float, ...] = (1.0, 1.2)
    ef_construction: int = 64
    beam_construction: int = 1

    def __post_init__(self):
        if self.metric not in ("l2", "ip", "cosine") or self.bits not in (1, 2) or not 1 <= self.m <= 512:
            raise ValueError("option out of range")
        if not all(1.0 <= a <= 2.0 for a in self.alpha) or not 1 <= self.ef_construction <= 65535 or not 1 <= self.beam_construction <= 65535:
            raise ValueError("option out of range")


def _to(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared L2, or minus the inner product."""
    return -(x @ q) if metric == "ip" else ((x - q) ** 2).sum(1)


def robust_prune(metric: str, x: np.ndarray, node: int, candidates: np.ndarray, m: int, alphas: tuple[float, ...]) -> np.ndarray:
    """At most m neighbours: near first, without those that a chosen one is nearer to by the slack; then filled up."""
    candidates = np.array([c for c in dict.fromkeys(candidates.tolist()) if c != node], np.int64)
    d = _to(metric, x[candidates], x[node])
    order = np.argsort(d, kind="stable")
    candidates, d, y = candidates[order], d[order], x[candidates[order]]
    if metric != "ip" and y.size * len(y) <= PAIRS:
        apart = ((y[:, None] - y) ** 2).sum(2)
    else:
        apart = np.array([_to(metric, y, c) for c in y]).reshape(len(y), len(y))
    chosen: list[int] = []
    for alpha in alphas if metric != "ip" else (1.0,):
        if len(chosen) >= m:
            break
        # A row of bits per candidate: whom it keeps out once it is chosen.
        out = [int.from_bytes(row.tobytes(), "little") for row in np.packbits(~(alpha * apart > d), axis=1, bitorder="little")]
        barred = 0
        for c in chosen:
            barred |= out[c] | 1 << c
        for c in range(len(d)):
            if len(chosen) < m and not barred >> c & 1:
                chosen.append(c)
                barred |= out[c]
    rest = np.ones(len(d), bool)
    rest[chosen] = False
    return candidates[[*chosen, *np.flatnonzero(rest)[: m - len(chosen)].tolist()]]


def beam_search(score, neighbours, start: int, ef: int, beam: int = 1) -> list[tuple[float, int]]:
    """The ef best (score, node) reached; stops once the best open node is worse than the ef-th found."""
    first = float(score(np.array([start]))[0])
    seen, open_, best = {start}, [(first, start)], [(-first, start)]
    while open_:
        if len(best) >= ef and open_[0][0] > -best[0][0]:
            break
        step = [heapq.heappop(open_)[1] for _ in range(min(beam, len(open_)))]
        fresh = [n for s in step for n in neighbours[s].tolist() if n not in seen]
        fresh = list(dict.fromkeys(fresh))
        if not fresh:
            continue
        seen.update(fresh)
        for d, n in zip(score(np.array(fresh)).tolist(), fresh):
            if len(best) < ef or d < -best[0][0]:
                heapq.heappush(open_, (d, n))
                heapq.heappush(best, (-d, n))
                if len(best) > ef:
                    heapq.heappop(best)
    return sorted((-d, n) for d, n in best)


def build_graph(x: np.ndarray, options: GraphOptions) -> list[np.ndarray]:
    """Neighbour lists by repeated insertion, starting at row 0."""
    graph: list[np.ndarray] = [np.zeros(0, np.int64)]
    for node in range(1, len(x)):
        found = beam_search(lambda at: _to(options.metric, x[at], x[node]), graph, 0, options.ef_construction, options.beam_construction)
        graph.append(robust_prune(options.metric, x, node, np.array([n for _, n in found]), options.m, options.alpha))
        for other in graph[node].tolist():
            joined = np.append(graph[other], node)
            graph[other] = joined if len(joined) <= options.m else robust_prune(options.metric, x, other, joined, options.m, options.alpha)
    return graph


def _coded_distance(metric: str, code: np.ndarray, factors: dict, bits: int):
    """For an exact rotated query, a function that scores nodes by their codes."""
    lattice = code.astype(np.float64) - ((1 << bits) - 1) / 2
    with np.errstate(invalid="ignore", divide="ignore"):
        scale = np.nan_to_num(np.sqrt(factors["sum_of_x2"]) / factors["norm_of_lattice"])

    def to(q: np.ndarray):
        square = q @ q
        if metric == "ip":
            return lambda at: -(lattice[at] @ q) * scale[at]
        return lambda at: factors["sum_of_x2"][at] + square - 2 * (lattice[at] @ q) * scale[at]

    return to


def _searched(data: bytes, options: GraphOptions, ef: int, width: int):
    """For a query and its rotation: ids that a beam over the codes of a stored graph finds, and their exact distances."""
    ids, x, (code, factors), graph = pickle.loads(data)
    coded, metric = _coded_distance(options.metric, code, factors, options.bits), options.metric

    def answer(q: np.ndarray, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.array([n for _, n in beam_search(coded(rotated), graph, 0, ef, width)])
        d = _to(metric, x[at], q)
        return ids[at], d if metric == "ip" else np.sqrt(d) if metric == "l2" else d / 2

    return answer


@dataclass
class GraphIndex:
    """``path``: a row per graph (part, data): ids, vectors, codes and neighbours of one partition."""

    spark: SparkSession
    path: str
    options: GraphOptions
    dim: int

    @classmethod
    def build(cls, df: DataFrame, path: str, options: GraphOptions = GraphOptions(), id_col: str = "vec_id", vec_col: str = "embedding", parts: int | None = None) -> "GraphIndex":
        """Rows are dealt by hash of id to ``parts`` graphs (default: the session's partitions), or to more, of some NODES rows
        each, where those would be larger; null vectors are not indexed."""
        rows = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        first = rows.select(F.size("vec").alias("n")).first()
        dim = first["n"] if first else 1
        if not 1 <= dim <= MAX_DIMENSION:
            raise ValueError(f"dimension must be from 1 to {MAX_DIMENSION}")

        def run(batches):
            held = [(b.column(0).to_numpy(), matrix(b.column(1), dim)[1]) for b in batches if b.num_rows]
            if held:
                ids, x = (np.concatenate(h) for h in zip(*held))
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                if options.metric == "cosine":
                    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
                code = rabitq.lattice_code(rabitq.rotate(x), options.bits)
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[0])]), pa.array([pickle.dumps((ids, x, code, build_graph(x, options)))], pa.binary())], ["part", "data"])

        least_parts = -(-rows.count() // NODES)
        if not parts and least_parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            parts = least_parts
        dealt = rows.repartition(max(parts, least_parts), "id") if parts else rows.repartition("id")
        dealt.mapInArrow(run, "part long, data binary").write.mode("overwrite").parquet(path)
        return cls(df.sparkSession, path, options, dim)

    def search(self, query, k: int, ef_search: int = 64, beam_search_width: int = 1, where: DataFrame | None = None, max_scan: int = -1, radius: float | None = None) -> DataFrame:
        """(id, distance): a beam over codes in each graph, exact reranking of what it found, one merged top-k."""
        if not 1 <= ef_search <= 65535 or not 1 <= beam_search_width <= 65535:
            raise ValueError("option out of range")
        if query is None:
            return self.spark.createDataFrame([], "id long, distance double")
        q = np.asarray(query, np.float64)
        if len(q) != self.dim:
            raise ValueError("dimension is not matched")
        if self.options.metric == "cosine":
            q = q / np.sqrt(q @ q)
        rotated, options = rabitq.rotate(q)[0], self.options

        def run(batches):
            for batch in batches:
                for data in batch.column(1):
                    ids, d = _searched(data.as_py(), options, ef_search, beam_search_width)(q, rotated)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(d)], ["id", "distance"])

        found = self.spark.read.parquet(self.path).mapInArrow(run, "id long, distance double")
        if max_scan >= 0:
            found = found.orderBy("distance", "id").limit(max_scan)
        if where is not None:
            found = found.join(where.toDF("id"), "id", "left_semi")
        if radius is not None:
            found = found.where(F.col("distance") < float(radius))
        return found.orderBy("distance", "id").limit(k)

    def search_many(self, queries: DataFrame, k: int, ef_search: int = 64, beam_search_width: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """(query_id, id, distance): what ``search`` finds for every row of ``queries``; each graph is read once a block.

        Queries go to the tasks in blocks of some QUERY_BYTES; each task keeps k a query and graph, then a window merges them.
        Null queries find nothing.
        """
        if not 1 <= ef_search <= 65535 or not 1 <= beam_search_width <= 65535:
            raise ValueError("option out of range")
        given = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<double>").alias("q"))
        parts = max(1, -(-given.count() * self.dim * 8 // QUERY_BYTES))
        out = self.spark.createDataFrame([], _FOUND)
        for part in range(parts):
            block = given.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow()
            if not block.num_rows:
                continue
            _, q = matrix(block.column(1), self.dim)
            if self.options.metric == "cosine":
                q = q / np.sqrt((q * q).sum(1, keepdims=True))
            run = _many(block.column(0).to_numpy(), q, self.options, k, ef_search, beam_search_width)
            out = out.unionByName(self.spark.read.parquet(self.path).mapInArrow(run, _FOUND))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        return out.withColumn("r", rank).where(F.col("r") <= k).drop("r")

    def rows(self) -> DataFrame:
        def run(batches):
            for batch in batches:
                for data in batch.column(1):
                    ids, x, *_ = pickle.loads(data.as_py())
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), vec], ["id", "vec"])

        return self.spark.read.parquet(self.path).mapInArrow(run, "id long, vec array<double>")

    def maintain(self, path: str, deleted: DataFrame | None = None, inserted: DataFrame | None = None) -> "GraphIndex":
        """A rebuilt copy without ``deleted`` (ids) and with ``inserted`` (id, vec)."""
        rows = self.rows()
        rows = rows if deleted is None else rows.join(deleted.toDF("id"), "id", "left_anti")
        rows = rows if inserted is None else rows.unionByName(inserted.toDF("id", "vec").withColumn("vec", F.col("vec").cast("array<double>")))
        return GraphIndex.build(rows, path, self.options, "id", "vec")

    def prewarm(self) -> str:
        parts = self.spark.read.parquet(self.path).persist()
        return f"graphs: {parts.count()}"


def _many(names: np.ndarray, q: np.ndarray, options: GraphOptions, k: int, ef: int, width: int):
    def run(batches):
        rotated = rabitq.rotate(q)
        for batch in batches:
            for data in batch.column(1):
                answer = _searched(data.as_py(), options, ef, width)
                for at in range(0, len(q), ANSWERS):
                    out = []
                    for i in range(at, min(at + ANSWERS, len(q))):
                        ids, d = answer(q[i], rotated[i])
                        pick = least(d, ids, k)
                        out.append((np.full(len(pick), names[i]), ids[pick], d[pick]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], ["query_id", "id", "distance"])

    return run
