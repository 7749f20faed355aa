"""Inverted-file index on ordinary tables: sampled k-means, assignment, partition-pruned search with bounds and rerank."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spherion.functions import kmeans, rabitq
from spherion.functions.kernels import distances, least, matrix

MAX_DIMENSION, MAX_LEVELS, EPSILON = 60000, 8, 1.9
#: Bytes of the sample that the driver clusters at most, and tasks that rewrite one list (a list may hold most rows).
SAMPLE_BYTES, LIST_TASKS = 256 << 20, 8
#: Bytes of queries that tasks get at once.
QUERY_BYTES = 16 << 20


@dataclass(frozen=True)
class IvfOptions:
    """``lists``: centroids per level from the root's children to the leaves; empty: one list that holds all.

    ``rerank_in_table`` stores codes without vectors, so searches need the table.  ``build_threads``,
    ``degree_of_parallelism`` and ``pin`` are checked and kept, no more: Spark's own tasks and ``prewarm`` take their place.
    """

    lists: tuple[int, ...] = ()
    metric: str = "l2"
    residual_quantization: bool = False
    rerank_in_table: bool = False
    degree_of_parallelism: int = 32
    sampling_factor: int = 256
    kmeans_iterations: int = 10
    kmeans_dimension: int | None = None
    kmeans_algorithm: str = "lloyd"
    spherical_centroids: bool = False
    build_threads: int = 1
    pin: int = -1

    def __post_init__(self):
        if len(self.lists) > MAX_LEVELS or list(self.lists) != sorted(self.lists) or any(n < 1 for n in self.lists):
            raise ValueError("lists must be at most 8 ascending positive numbers")
        if self.metric not in ("l2", "ip", "cosine"):
            raise ValueError("unknown metric")
        if not 1 <= self.degree_of_parallelism <= 256 or not -1 <= self.pin <= 2 or self.sampling_factor < 1 or self.kmeans_iterations < 0:
            raise ValueError("option out of range")

    @classmethod
    def from_toml(cls, text: str, metric: str = "l2") -> "IvfOptions":
        """``residual_quantization = true`` ... ``[build.internal] lists = [64]``; unknown keys are errors."""
        given = tomllib.loads(text)
        build = given.pop("build", {})
        internal = build.pop("internal", {}) if isinstance(build, dict) else {}
        flat = given | build | internal
        unknown = set(flat) - {f for f in cls.__dataclass_fields__ if f != "metric"}
        if unknown:
            raise ValueError(f"unknown field: {', '.join(sorted(unknown))}")
        if isinstance(flat.get("pin"), bool):
            flat["pin"] = int(flat["pin"])
        return cls(**{k: tuple(v) if k == "lists" else v for k, v in flat.items()}, metric=metric)


def checked_probes(probes: str | list[int] | None, levels: int) -> list[int]:
    """As many numbers as levels, each 0 or more."""
    given = [int(p) for p in probes.split(",") if p.strip()] if isinstance(probes, str) else list(probes or [])
    if len(given) != levels:
        raise ValueError(f"need {levels} probes, but {len(given)} probes provided")
    return given


def external_centroids(table: DataFrame, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels (vectors, parent positions) of a centroid table (id, parent, vector), top level first; checked."""
    rows = [(r["id"], r["parent"], r["vector"]) for r in table.select("id", "parent", "vector").collect()]
    ids = [r[0] for r in rows]
    if len(set(ids)) < len(ids):
        raise ValueError("duplicate id in centroids")
    if any(v is None or len(v) != dim for *_, v in rows):
        raise ValueError("incorrect dimension in centroids")
    parent, vec = {i: p for i, p, _ in rows}, {i: np.array(v, np.float64) for i, _, v in rows}
    if all(p is None for p in parent.values()):
        return [(np.stack([vec[i] for i in sorted(ids)]), np.zeros(len(ids), np.int64))]
    if any(p is not None and p not in parent for p in parent.values()):
        raise ValueError("missing parent in centroids")
    roots = [i for i, p in parent.items() if p is None]
    if len(roots) != 1:
        raise ValueError("centroids must have one root")
    level, out, seen, where = sorted(i for i in ids if parent[i] == roots[0]), [], {roots[0]}, {roots[0]: 0}
    while level:
        out.append((np.stack([vec[i] for i in level]), np.array([where[parent[i]] for i in level])))
        seen |= set(level)
        where = {i: k for k, i in enumerate(level)}
        below = sorted(i for i in ids if parent[i] in where)
        if below and {parent[i] for i in below} != set(level):
            raise ValueError("centroids have leaves of unequal height")
        level = below
    if seen != set(ids):
        raise ValueError("centroids have a cycle")
    if not 1 <= len(out) <= MAX_LEVELS:
        raise ValueError("centroids must have 1 to 8 levels")
    return out


@dataclass
class IvfIndex:
    """``levels``: (centroids, parents), bounded by ``lists``; ``path``: rows (id, seq, vec, code) partitioned by list_id.

    Beside the rows lie ``path``.meta (options and centroids, which ``open`` reads), ``path``.log (a row per change) and
    ``path``.deleted (id, seq).  Changes are numbered; a deletion holds for rows with smaller numbers only, so an id may come
    back.  One writer at a time; readers see what was written when they planned.
    """

    spark: SparkSession
    path: str
    options: IvfOptions
    dim: int
    levels: list[tuple[np.ndarray, np.ndarray]] = field(repr=False)

    # Build

    @classmethod
    def build(cls, df: DataFrame, path: str, options: IvfOptions = IvfOptions(), id_col: str = "vec_id", vec_col: str = "embedding", centroids: DataFrame | None = None) -> "IvfIndex":
        """Sample, cluster, assign.  Null vectors are not indexed."""
        rows = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        first = rows.select(F.size("vec").alias("n")).first()
        dim = first["n"] if first else 1
        if not 1 <= dim <= MAX_DIMENSION:
            raise ValueError(f"dimension must be from 1 to {MAX_DIMENSION}")
        if centroids is not None:
            levels = external_centroids(centroids, dim)
        elif options.lists:
            n = min(options.lists[-1] * options.sampling_factor, max(SAMPLE_BYTES // (8 * dim), 1))
            sample = rows.orderBy(F.xxhash64("id"), "id").limit(n).select("vec").toArrow()
            _, x = matrix(sample.column(0), dim)
            x = _unit(x) if options.metric == "cosine" else x
            levels, lower = [], x
            for k in reversed(options.lists):
                lower = kmeans.train(lower, k, options.kmeans_iterations, options.spherical_centroids, options.kmeans_dimension if lower is x else None, options.kmeans_algorithm)
                levels.insert(0, lower)
            levels = [(c, np.zeros(len(c), np.int64) if k == 0 else kmeans.assign(c, levels[k - 1])) for k, c in enumerate(levels)]
        else:
            levels = [(np.zeros((1, dim)), np.zeros(1, np.int64))]
        index = cls(df.sparkSession, path, options, dim, levels)
        index._start()
        index._assigned(rows, 0).write.mode("overwrite").partitionBy("list_id").parquet(path)
        index._describe()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "IvfIndex":
        """The index that ``build`` or ``vacuum`` left at ``path``."""
        rows = spark.read.parquet(path + ".meta").collect()  # as many as centroids, which one driver clustered
        facts = json.loads(next(r["facts"] for r in rows if r["level"] < 0))
        facts["options"]["lists"] = tuple(facts["options"]["lists"])
        levels = []
        for k in range(facts["levels"]):
            own = sorted((r for r in rows if r["level"] == k), key=lambda r: r["node"])
            levels.append((np.array([r["centroid"] for r in own], np.float64).reshape(len(own), -1), np.array([r["parent"] for r in own], np.int64)))
        return cls(spark, path, IvfOptions(**facts["options"]), facts["dim"], levels)

    def _start(self) -> None:
        """Nothing of an older index at this path stays."""
        for suffix in ("", ".meta", ".log", ".deleted"):
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + suffix)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _describe(self) -> None:
        facts = json.dumps({"options": asdict(self.options), "dim": self.dim, "levels": len(self.levels)})
        rows = [(-1, 0, 0, [], facts)] + [(k, node, int(parents[node]), c[node].tolist(), None) for k, (c, parents) in enumerate(self.levels) for node in range(len(c))]
        schema = "level int, node int, parent int, centroid array<double>, facts string"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(self.path + ".meta")

    def _exists(self, suffix: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + suffix)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _next(self, what: str) -> int:
        """A number above all changes before, with ``what`` noted in the log; a change of the same name keeps its number."""
        log = self.spark.read.schema("seq long, what string").parquet(self.path + ".log") if self._exists(".log") else None
        if log is not None and what and (old := log.where(F.col("what") == what).first()):
            return old["seq"]
        seq = 1 + ((log.agg(F.max("seq")).first()[0] or 0) if log is not None else 0)
        self.spark.createDataFrame([(seq, what)], "seq long, what string").coalesce(1).write.mode("append").parquet(self.path + ".log")
        return seq

    @property
    def schema(self) -> str:
        return "id long, vec array<double>, list_id int, signs binary, dis_u_2 double, factor_cnt double, factor_ip double, factor_err double, seq long"

    def _assigned(self, rows: DataFrame, seq: int) -> DataFrame:
        levels, metric, dim, residual, bare = self.levels, self.options.metric, self.dim, self.options.residual_quantization, self.options.rerank_in_table

        def run(batches):
            for batch in batches:
                _, x = matrix(batch.column(1), dim)
                x = _unit(x) if metric == "cosine" else x
                leaf = np.zeros(len(x), np.int64)
                for k, (c, parents) in enumerate(levels):
                    if k == 0:
                        leaf = kmeans.assign(x, c)
                    else:
                        for node in np.unique(leaf):
                            at, children = np.flatnonzero(leaf == node), np.flatnonzero(parents == node)
                            leaf[at] = -1 - (children[kmeans.assign(x[at], c[children])] if len(children) else 0)
                        leaf = -1 - leaf
                signs, factors = rabitq.binary_code(rabitq.rotate(x - levels[-1][0][leaf] if residual else x))
                packed = np.packbits(signs, axis=1, bitorder="little")
                vec = pa.nulls(len(x), pa.list_(pa.float64())) if bare else pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), vec, pa.array(leaf.astype(np.int32)), pa.array([p.tobytes() for p in packed], pa.binary()), *(pa.array(np.asarray(factors[f], np.float64)) for f in ("dis_u_2", "factor_cnt", "factor_ip", "factor_err")), pa.array(np.full(len(x), seq))],
                    ["id", "vec", "list_id", "signs", "dis_u_2", "factor_cnt", "factor_ip", "factor_err", "seq"],
                )

        return rows.mapInArrow(run, self.schema)

    # Change

    def insert(self, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", once: str = "") -> None:
        """Appends rows.  A change named ``once`` that is tried again after a failure adds only what it hasn't added yet."""
        rows = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        seq = self._next(once)
        if once:
            done = self._stored().where(F.col("seq") == seq).select("id")
            rows = rows.join(done, "id", "left_anti")
        self._assigned(rows, seq).write.mode("append").partitionBy("list_id").parquet(self.path)

    def delete(self, ids: DataFrame) -> None:
        """Marks the rows of ids as deleted that are there now; ``vacuum`` rewrites without them."""
        seq = self._next("")
        ids.toDF("id").select(F.col("id").cast("long"), F.lit(seq).cast("long").alias("seq")).write.mode("append").parquet(self.path + ".deleted")

    def upsert(self, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        """Rows in place of those with the same ids."""
        self.delete(df.select(id_col))
        self.insert(df, id_col, vec_col)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(*[c.split()[0] for c in self.schema.split(", ")])

    def rows(self) -> DataFrame:
        out = self._stored()
        if not self._exists(".deleted"):
            return out
        gone = self.spark.read.schema("id long, seq long").parquet(self.path + ".deleted").groupBy(F.col("id").alias("gone")).agg(F.max("seq").alias("until"))
        return out.join(gone, (out["id"] == gone["gone"]) & (out["seq"] < gone["until"]), "left_anti")

    def vacuum(self, path: str) -> "IvfIndex":
        """A compacted copy at another path without what is deleted."""
        if path == self.path:
            raise ValueError("vacuum writes to another path")
        other = IvfIndex(self.spark, path, self.options, self.dim, self.levels)
        other._start()
        rows = self.rows().withColumn("seq", F.lit(0).cast("long"))
        rows.repartition("list_id", F.pmod(F.xxhash64("id"), F.lit(LIST_TASKS))).write.mode("overwrite").partitionBy("list_id").parquet(path)
        other._describe()
        return other

    # Search

    def probed_lists(self, query: np.ndarray, probes: str | list[int] | None) -> list[int]:
        """Leaves below the nearest nodes of each level."""
        if probes is None and len(self.levels) == 1 and not self.options.lists:
            probes = [1]
        live = None
        for (c, parents), p in zip(self.levels, checked_probes(probes, len(self.levels))):
            nodes = np.arange(len(c)) if live is None else np.flatnonzero(np.isin(parents, live))
            d = ((c[nodes] - query) ** 2).sum(1) if self.options.metric == "l2" else -(c[nodes] @ query)
            live = nodes[np.argsort(d, kind="stable")[:p]]
        return [int(x) for x in live]

    def search(self, query, k: int, probes: str | list[int] | None = None, epsilon: float = EPSILON, where: DataFrame | None = None, prefilter: bool = True, bounds: bool = True, table: DataFrame | None = None, max_scan: int = -1, radius: float | None = None) -> DataFrame:
        """(id, distance) of the k nearest found in the probed lists, exactly reranked.

        ``where``: ids that qualify, applied before scoring (``prefilter``) or after.  ``bounds``: each batch reranks only
        rows whose lower bound at ``epsilon`` is not beyond its k-th exact distance.  ``table`` (id, vec): exact vectors come
        from there (rerank_in_table).  ``radius`` keeps what is strictly nearer.  A null query finds nothing.
        """
        if not 0 <= epsilon <= 4:
            raise ValueError("epsilon must be from 0 to 4")
        empty = self.spark.createDataFrame([], "id long, distance double")
        if query is None:
            return empty
        q = np.asarray(query, np.float64)
        if len(q) != self.dim:
            raise ValueError("dimension is not matched")
        metric = self.options.metric
        q = _unit(q[None])[0] if metric == "cosine" else q
        lists = self.probed_lists(q, probes)
        if not lists:
            return empty
        rows = self.rows().where(F.col("list_id").isin(lists))
        if where is not None and prefilter:
            rows = rows.join(where.toDF("id"), "id", "left_semi")
        if table is None and self.options.rerank_in_table:
            raise ValueError("the index holds no vectors: give the table")
        if table is not None:
            rows = rows.drop("vec").join(table.toDF("id", "vec"), "id").select(*[c.split()[0] for c in self.schema.split(", ")])
        keep = max(k if max_scan < 0 else max_scan, 1) if where is None or prefilter else None
        scored = rows.mapInArrow(_reranked(metric, q, keep if radius is None else None, epsilon, bounds and radius is None, self.dim, self.levels[-1][0] if self.options.residual_quantization else None), "id long, distance double")
        if max_scan >= 0:
            scored = scored.orderBy("distance", "id").limit(max_scan)
        if where is not None and not prefilter:
            scored = scored.join(where.toDF("id"), "id", "left_semi")
        if radius is not None:
            scored = scored.where(F.col("distance") < float(radius))
        return scored.orderBy("distance", "id").limit(k)

    def search_many(self, queries: DataFrame, k: int, probes: str | list[int] | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """(query_id, id, distance): the k nearest in the probed lists for every row of ``queries``, in one pass a block.

        Queries go to the tasks in blocks of some QUERY_BYTES; each task keeps k a query and batch, then a window merges them.
        Null queries find nothing; distances are exact.
        """
        if self.options.rerank_in_table:
            raise ValueError("the index holds no vectors: search with the table")
        given = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<double>").alias("q"))
        n = given.count()
        parts = max(1, -(-n * self.dim * 8 // QUERY_BYTES))
        out = self.spark.createDataFrame([], "query_id long, id long, distance double")
        for part in range(parts):
            block = given.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow()
            _, q = matrix(block.column(1), self.dim)
            q = _unit(q) if self.options.metric == "cosine" else q
            names = block.column(0).to_numpy()
            wanted: dict[int, list[int]] = {}
            for k_, row in enumerate(q):
                for node in self.probed_lists(row, probes):
                    wanted.setdefault(node, []).append(k_)
            if wanted:
                rows = self.rows().where(F.col("list_id").isin(sorted(wanted))).select("id", "list_id", "vec")
                found = rows.mapInArrow(_many(self.options.metric, names, q, wanted, k, self.dim), "query_id long, id long, distance double")
                out = out.unionByName(found)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        return out.withColumn("r", rank).where(F.col("r") <= k).drop("r")

    def prewarm(self, height: int = 0) -> str:
        """Caches the rows of the index and tells the nodes of each level down to ``height``."""
        if not 0 <= height <= len(self.levels):
            raise ValueError("height out of range")
        rows = self.rows().persist()
        shown = [f"height {len(self.levels) - k}: {len(c)} nodes" for k, (c, _) in enumerate(self.levels) if len(self.levels) - k >= height]
        return "\n".join([*shown, f"rows: {rows.count()}"])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _many(metric, names, q, wanted, k, dim):
    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            _, x = matrix(batch.column(2), dim)
            near: dict[int, list] = {}
            for node in np.unique(lists):
                at, own = np.flatnonzero(lists == node), wanted.get(int(node), [])
                d = distances("l2" if metric == "l2" else "ip", q[own], x[at]) + (1 if metric == "cosine" else 0)
                for row, one in zip(d, own):
                    pick = least(row, ids[at], k)
                    near.setdefault(one, []).append((ids[at][pick], row[pick]))
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for one, parts in near.items():
                i, d = (np.concatenate(z) for z in zip(*parts))
                pick = least(d, i, k)
                out.append((np.full(len(pick), names[one]), i[pick], d[pick]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], ["query_id", "id", "distance"])

    return run


def _reranked(metric, q, keep, epsilon, bounds, dim, centroids):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            _, x = matrix(batch.column(1), dim)
            order = np.arange(len(ids))
            if bounds and keep and len(ids) > keep:
                signs = np.unpackbits(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(ids), -1), axis=1, bitorder="little")[:, :dim].astype(bool)
                factors = {f: batch.column(batch.schema.get_field_index(f)).to_numpy() for f in ("dis_u_2", "factor_ip", "factor_err")}
                kind = "l2" if metric == "l2" else "ip"
                if centroids is None:
                    low = rabitq.lower_bound(kind, signs, factors, rabitq.rotate(q)[0], epsilon)
                else:
                    lists, low = batch.column(2).to_numpy(), np.empty(len(ids))
                    for node in np.unique(lists):
                        at = lists == node
                        shifted = rabitq.rotate(q - centroids[node] if kind == "l2" else q)[0]
                        low[at] = rabitq.lower_bound(kind, signs[at], {f: v[at] for f, v in factors.items()}, shifted, epsilon) - (0 if kind == "l2" else centroids[node] @ q)
                order = np.argsort(low, kind="stable")
                near = distances("l2" if metric == "l2" else "ip", q[None], x[order[:keep]])[0]
                worst = near.max() ** 2 if metric == "l2" else near.max()
                order = order[low[order] <= worst]
            d = distances("l2" if metric == "l2" else "ip", q[None], x[order])[0] + (1 if metric == "cosine" else 0)
            pick = least(d, ids[order], keep) if keep else np.arange(len(order))
            yield pa.RecordBatch.from_arrays([pa.array(ids[order][pick]), pa.array(d[pick])], ["id", "distance"])

    return run
