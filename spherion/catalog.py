"""Named queries over the driver's tables and the SQL they must agree with.

The query vector is that of vec_id 0; the query tensor holds vec_id 0 to 3; documents are runs of eight vec_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spherion.functions import distance as D
from spherion.operators import maxsim as M
from spherion.operators import quantized as Q
from spherion.operators.graph import GraphIndex, GraphOptions
from spherion.operators.ivf import IvfIndex, IvfOptions
from spherion.operators.topk import knn_join as nearest_join
from spherion.operators.topk import range_search, top_k, top_k_per_group
from spherion.plans import cost
from spherion.plans.scratch import scratch_path
from spherion.sources.registry import Registry, registered_search, tensor_rerank
from spherion.sources.tensors import TensorStore, descriptors

_QUERIES: dict = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLE[f.__name__] = _COMMON + sql
        return f

    return add


_COMMON = """with e as (select vec_id, cast(embedding as double[]) as v, label from embeddings where embedding is not null),
q as (select v as qv from e where vec_id = 0),
qt as (select vec_id as qi, v as tv from e where vec_id < 4),
tok as (select vec_id // 8 as doc_id, v from e),
cell as (select doc_id, qi, max(list_inner_product(v, tv)) as best from tok, qt group by doc_id, qi),
score as (select doc_id, -sum(best) as d from cell group by doc_id)
"""
_D = {"l2": "list_distance(v, qv)", "ip": "-list_inner_product(v, qv)", "cosine": "list_cosine_distance(v, qv)"}


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def query_vector(df: DataFrame) -> list[float] | None:
    row = df.where("vec_id = 0").select("embedding").first()
    return None if row is None else list(row[0])


def query_tensor(df: DataFrame) -> list[list[float]]:
    return [list(r[0]) for r in df.where("vec_id < 4 and embedding is not null").orderBy("vec_id").select("embedding").collect()]


def documents(df: DataFrame) -> DataFrame:
    """(doc_id, tokens): multi-vectors in order of vec_id."""
    rows = df.where("embedding is not null").select(F.expr("vec_id div 8").alias("doc_id"), F.struct("vec_id", "embedding").alias("t"))
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["embedding"]).alias("tokens"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# Distances, top-k, range

def _top(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = embeddings(spark, sf_dir)
        return _rounded(top_k(df, query_vector(df), 10, metric).select("vec_id", "distance"), "distance")

    return run


def _range(metric: str, radius: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = embeddings(spark, sf_dir)
        return _rounded(range_search(df, query_vector(df), radius, metric).select("vec_id", "distance"), "distance")

    return run


RADIUS = {"l2": 1.3, "ip": -0.2, "cosine": 0.8}
for _name, _metric in (("l2", "l2"), ("ip", "ip"), ("cos", "cosine")):
    _QUERIES[f"{_name}_topk"], _QUERIES[f"{_name}_range"] = _top(_metric), _range(_metric, RADIUS[_metric])
    _ORACLE[f"{_name}_topk"] = f"{_COMMON} select vec_id, round(d, 6) + 0 as distance from (select vec_id, {_D[_metric]} as d from e, q) order by d, vec_id limit 10"
    _ORACLE[f"{_name}_range"] = f"{_COMMON} select vec_id, round({_D[_metric]}, 6) + 0 as distance from e, q where {_D[_metric]} < {RADIUS[_metric]}"


@query(f"select vec_id, round(d, 6) + 0 as distance from (select vec_id, {_D['l2']} as d from e, q) where d < 1.35 order by d, vec_id limit 25")
def l2_range_ordered(spark, sf_dir):
    """Order and sphere together: the sphere filters, the order ranks."""
    df = embeddings(spark, sf_dir)
    return _rounded(range_search(df, query_vector(df), 1.35).orderBy("distance", "vec_id").limit(25).select("vec_id", "distance"), "distance")


@query(f"select vec_id, round(d, 6) + 0 as distance from (select vec_id, {_D['l2']} as d from e, q where label in (1, 3, 5)) order by d, vec_id limit 10")
def filtered_topk(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return _rounded(top_k(df, query_vector(df), 10, where=F.col("label").isin(1, 3, 5)).select("vec_id", "distance"), "distance")


@query(f"select vec_id, round(d, 6) + 0 as distance from (select * from (select vec_id, label, {_D['l2']} as d from e, q) order by d, vec_id limit 40) where label in (1, 3, 5) order by d, vec_id limit 10")
def max_scan_topk(spark, sf_dir):
    """A cap on what the scan emits comes before the filter."""
    df = embeddings(spark, sf_dir)
    return _rounded(top_k(df, query_vector(df), 10, where=F.col("label").isin(1, 3, 5), max_scan=40).select("vec_id", "distance"), "distance")


@query(f"select label, vec_id, round(d, 6) + 0 as distance, cast(r as integer) as rank from (select label, vec_id, d, row_number() over (partition by label order by d, vec_id) as r from (select label, vec_id, {_D['l2']} as d from e, q)) where r <= 3")
def topk_per_label(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return _rounded(top_k_per_group(df, "label", query_vector(df), 3).select("label", "vec_id", "distance", "rank"), "distance")


@query("select query_id, neighbor_id, round(d, 6) + 0 as distance, cast(r as integer) as rank from (select *, row_number() over (partition by query_id order by d, neighbor_id) as r from (select a.vec_id as query_id, b.vec_id as neighbor_id, list_distance(a.v, b.v) as d from e a, e b where a.vec_id <> b.vec_id)) where r <= 5")
def knn_join(spark, sf_dir):
    """The five nearest others of every vector."""
    df = embeddings(spark, sf_dir)
    return _rounded(nearest_join(df, df, 5, exclude_self=True), "distance")


@query(f"select label, count(*) as n, round(min(d), 6) + 0 as least, round(max(d), 6) + 0 as most, round(avg(d), 6) + 0 as mean from (select label, {_D['cosine']} as d from e, q) group by label")
def dist_stats_by_label(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    d = df.where("embedding is not null").select("label", D.cosine("embedding", D.vector(query_vector(df))).alias("d"))
    out = d.groupBy("label").agg(F.count("*").alias("n"), F.min("d").alias("least"), F.max("d").alias("most"), F.avg("d").alias("mean"))
    return _rounded(out, "least", "most", "mean")


@query("select vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) + 0 as norm from e")
def vector_norm(spark, sf_dir):
    return embeddings(spark, sf_dir).where("embedding is not null").select("vec_id", F.round(D.norm("embedding"), 6).alias("norm"))


@query("select vec_id, round(v[1] / n, 6) + 0 as first, round(v[64] / n, 6) + 0 as last from (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from e)")
def vector_normalize(spark, sf_dir):
    unit = embeddings(spark, sf_dir).where("embedding is not null").select("vec_id", D.normalize("embedding").alias("u"))
    return unit.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.get("u", F.lit(63)), 6).alias("last"))


@query("select vec_id, round(v[1] + qv[1], 6) + 0 as added, round(v[2] - qv[2], 6) + 0 as subtracted, round(v[3] * qv[3], 6) + 0 as multiplied from e, q")
def vector_arith(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    v = D.vector(query_vector(df))
    rows = df.where("embedding is not null").select("vec_id", D.add("embedding", v).alias("a"), D.subtract("embedding", v).alias("s"), D.multiply("embedding", v).alias("m"))
    return rows.select("vec_id", F.round(F.get("a", F.lit(0)), 6).alias("added"), F.round(F.get("s", F.lit(1)), 6).alias("subtracted"), F.round(F.get("m", F.lit(2)), 6).alias("multiplied"))


@query("select vec_id, cast(list_sum(list_transform(range(1, 65), lambda i: case when (v[i] > 0) <> (qv[i] > 0) then 1 else 0 end)) as bigint) as hamming, cast(-list_sum(list_transform(range(1, 65), lambda i: case when v[i] > 0 and qv[i] > 0 then 1 else 0 end)) as bigint) as dot, round(1 - list_sum(list_transform(range(1, 65), lambda i: case when v[i] > 0 and qv[i] > 0 then 1 else 0 end)) / list_sum(list_transform(range(1, 65), lambda i: case when v[i] > 0 or qv[i] > 0 then 1 else 0 end)), 6) + 0 as jaccard from e, q")
def bit_distances(spark, sf_dir):
    """Distances of sign bits, packed into one 64-bit word."""
    df = embeddings(spark, sf_dir)

    def word(v):
        return F.array(F.aggregate(F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))

    rows = df.where("embedding is not null").select("vec_id", word(F.col("embedding")).alias("w"), word(D.vector(query_vector(df))).alias("q"))
    return rows.select("vec_id", D.hamming("w", "q").cast("long").alias("hamming"), D.bit_dot("w", "q").cast("long").alias("dot"), F.round(D.jaccard("w", "q"), 6).alias("jaccard"))


@query("select vec_id, round(list_sum(list_transform(range(1, 65), lambda i: case when v[i] > 0.1 and qv[i] > 0.1 then v[i] * qv[i] else 0 end)), 6) + 0 as dot, round(list_sum(list_transform(range(1, 65), lambda i: (case when v[i] > 0.1 then v[i] else 0 end - case when qv[i] > 0.1 then qv[i] else 0 end) ** 2)), 6) + 0 as l2_squared from e, q")
def sparse_distances(spark, sf_dir):
    """Sparse vectors of the components above 0.1."""
    df = embeddings(spark, sf_dir)

    def sparse(v):
        pairs = F.transform(D.doubles(v), lambda x, i: F.named_struct(F.lit("i"), i, F.lit("x"), x))
        return F.map_from_entries(F.filter(pairs, lambda t: t["x"] > 0.1))

    rows = df.where("embedding is not null").select("vec_id", sparse(F.col("embedding")).alias("s"), sparse(D.vector(query_vector(df))).alias("q"))
    return rows.select("vec_id", F.round(D.sparse_dot("s", "q"), 6).alias("dot"), F.round(D.sparse_l2_squared("s", "q"), 6).alias("l2_squared"))


# MaxSim

@query("select doc_id, round(d, 6) + 0 as distance from score order by d, doc_id limit 10")
def maxsim_topk(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return _rounded(M.maxsim_top_k(documents(df), query_tensor(df), 10).select(F.col("id").alias("doc_id"), "distance"), "distance")


@query("select doc_id, round(d, 6) + 0 as distance from score")
def maxsim_pair_scores(spark, sf_dir):
    """As a Catalyst expression over every document."""
    df = embeddings(spark, sf_dir)
    tensor = F.array(*[D.vector(t) for t in query_tensor(df)])
    return documents(df).select("doc_id", F.round(M.maxsim_distance("tokens", tensor), 6).alias("distance"))


@query("select doc_id as public_id, round(-d, 6) + 0 as similarity from score where doc_id in (1, 3, 5, 7, 11, 1000000) order by d, doc_id limit 4")
def maxsim_rerank_ids(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return _rounded(M.rerank_ids(documents(df), query_tensor(df), [1, 3, 5, 7, 11, 1000000], 4), "similarity")


@query("select doc_id, round(d, 6) + 0 as distance from score order by d, doc_id limit 2")
def maxsim_candidate_limit(spark, sf_dir):
    """A candidate limit below the limit cuts the result; refining every token makes the candidates exact."""
    df = embeddings(spark, sf_dir)
    options = M.CoarseOptions(refine=1 << 30, candidate_limit=2, backend="cpu_exact")
    return _rounded(M.maxsim_search(documents(df), query_tensor(df), 10, options).select(F.col("id").alias("doc_id"), "distance"), "distance")


@query()
def maxsim_coarse(spark, sf_dir):
    """The estimated order of 1-bit codes."""
    df = embeddings(spark, sf_dir)
    return M.coarse_candidates(documents(df), query_tensor(df)).limit(20)


@query()
def maxsim_indexed(spark, sf_dir):
    """Candidates from an inverted file of tokens; cells that no probed list holds are estimated."""
    df = embeddings(spark, sf_dir)
    index = IvfIndex.build(M.token_rows(documents(df)), scratch_path(spark, "tokens"), IvfOptions(lists=(16,), metric="ip"))
    return _rounded(M.indexed_candidates(index, query_tensor(df), [4], M.CoarseOptions(refine=64, threshold=400, candidate_limit=20)), "estimate")


@query()
def maxsim_two_stage(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    options = M.CoarseOptions(refine=64, candidate_limit=32, backend="auto")
    return _rounded(M.maxsim_search(documents(df), query_tensor(df), 10, options), "distance")


def _tensors(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    docs = documents(df).select("doc_id", "tokens", F.lit("demo-v1").alias("model_contract"))
    store = TensorStore(spark, scratch_path(spark, "tensors"))
    described = descriptors(docs, dtype="float32")
    store.publish(described)
    docs.createOrReplaceTempView("spherion_docs")
    described.drop("payload").withColumnRenamed("id", "source_id").createOrReplaceTempView("spherion_descriptors")
    registry = Registry(spark)
    registry.register("demo", "spherion_docs", "doc_id", "model_contract", " demo-v1 ", "External_Relation", descriptor_relation="spherion_descriptors", descriptor_id="source_id")
    return df, docs, store, registry


@query("select doc_id as public_id, round(-d, 5) + 0 as similarity from score where doc_id in (0, 2, 4, 6, 8, 10) order by d, doc_id limit 3")
def tensor_source_rerank(spark, sf_dir):
    """Exact scores of external tensors of a registered source."""
    df, _, store, registry = _tensors(spark, sf_dir)
    return tensor_rerank(registry, store, "demo", query_tensor(df), [0, 2, 4, 6, 8, 10], 3).withColumn("similarity", F.round("similarity", 5))


@query()
def tensor_source_search(spark, sf_dir):
    df, docs, store, registry = _tensors(spark, sf_dir)
    return registered_search(registry, store, "demo", docs, query_tensor(df), 32, 10).withColumn("similarity", F.round("similarity", 5))


@query("select doc_id as id, 8 as tensor_rows, 64 as tensor_dim from tok group by doc_id having count(*) = 8")
def tensor_resolve(spark, sf_dir):
    """Publish, publish again, resolve with verification."""
    _, docs, store, registry = _tensors(spark, sf_dir)
    store.publish(descriptors(docs, dtype="float32"))
    return store.resolve(registry.described("demo", True)).where("tensor_rows = 8 and payload is not null").select("id", "tensor_rows", "tensor_dim")


# Relational composition

@query("select label, cast(count(*) as bigint) as n, round(avg(v[1]), 6) + 0 as first, round(avg(v[64]), 6) + 0 as last from e group by label")
def centroid_means(spark, sf_dir):
    df = embeddings(spark, sf_dir).where("embedding is not null")
    return _rounded(df.groupBy("label").agg(F.count("*").alias("n"), F.avg(F.get("embedding", F.lit(0)).cast("double")).alias("first"), F.avg(F.get("embedding", F.lit(63)).cast("double")).alias("last")), "first", "last")


_CENTROIDS = "c as (select label as c_label, list_transform(range(1, 65), lambda i: list_avg(list_transform(list(v), lambda x: x[i]))) as cv from e group by label)"


def centroids_of(df: DataFrame) -> DataFrame:
    """(id, vector): the mean embedding of each label, component-wise."""
    pieces = df.where("embedding is not null").select("label", F.posexplode("embedding").alias("i", "x"))
    means = pieces.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("vector")).select(F.col("label").cast("long").alias("id"), "vector")


def nearest_centroid_assign(spark, sf_dir):
    """Each vector's nearest label centroid."""
    df = embeddings(spark, sf_dir)
    c = centroids_of(df).select("id", F.col("vector").alias("embedding"))
    scored = nearest_join(df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), c.withColumnRenamed("id", "vec_id"), 1)
    return _rounded(scored.select(F.col("query_id").alias("vec_id"), F.col("neighbor_id").cast("int").alias("c_label"), "distance"), "distance")


_QUERIES["nearest_centroid_assign"] = nearest_centroid_assign
_ORACLE["nearest_centroid_assign"] = _COMMON.rstrip() + f", {_CENTROIDS} select vec_id, cast(c_label as integer) as c_label, round(d, 6) + 0 as distance from (select vec_id, c_label, d, row_number() over (partition by vec_id order by d, c_label) as r from (select vec_id, c_label, list_distance(v, cv) as d from e, c)) where r = 1"


@query(f"select e.label, cast(count(*) as bigint) as n, cast(sum(l.quality) as bigint) as quality from e, q, labels l where l.doc_id = e.vec_id and {_D['l2']} < 1.4 group by e.label")
def sphere_semi_join(spark, sf_dir):
    """A sphere below a join and an aggregation."""
    df = embeddings(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    near = range_search(df, query_vector(df), 1.4).select("vec_id", "label")
    return near.join(labels, near["vec_id"] == labels["doc_id"]).groupBy("label").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("quality"))


@query(f"select vec_id from (select vec_id, {_D['l2']} as d from e, q order by d, vec_id limit 20) intersect select vec_id from (select vec_id, {_D['cosine']} as d from e, q order by d, vec_id limit 20)")
def recall_intersect(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    q = query_vector(df)
    return top_k(df, q, 20).select("vec_id").intersect(top_k(df, q, 20, "cosine").select("vec_id"))


# Indexes

def _ivf(spark, sf_dir, **options):
    df = embeddings(spark, sf_dir)
    return df, IvfIndex.build(df, scratch_path(spark, "ivf"), IvfOptions(**options))


@query(f"select vec_id as id, round(d, 6) + 0 as distance from (select vec_id, {_D['l2']} as d from e, q) order by d, vec_id limit 10")
def ivf_full_probe_topk(spark, sf_dir):
    """All lists probed and every row reranked: the exact answer."""
    df, index = _ivf(spark, sf_dir, lists=(8, 32))
    return _rounded(index.search(query_vector(df), 10, [8, 32], bounds=False), "distance")


@query(f"select vec_id as id, round(d, 6) + 0 as distance from (select vec_id, {_D['cosine']} as d from e, q) order by d, vec_id limit 10")
def rerank_in_table_topk(spark, sf_dir):
    """Exact vectors come from the base table."""
    df, index = _ivf(spark, sf_dir, metric="cosine", rerank_in_table=True)
    unit = df.where("embedding is not null").select("vec_id", D.normalize("embedding").alias("v"))
    return _rounded(index.search(query_vector(df), 10, bounds=False, table=unit), "distance")


@query(f"select vec_id as id, round(d, 6) + 0 as distance from (select vec_id, {_D['l2']} as d from e, q where label = 2) order by d, vec_id limit 10")
def ivf_prefilter_topk(spark, sf_dir):
    df, index = _ivf(spark, sf_dir, lists=(16,))
    return _rounded(index.search(query_vector(df), 10, [16], bounds=False, where=df.where("label = 2").select("vec_id")), "distance")


@query(f"select vec_id as id, round(d, 6) + 0 as distance from (select vec_id, {_D['l2']} as d from e, q) where d < 1.3 order by d, vec_id limit 1000000")
def ivf_range(spark, sf_dir):
    df, index = _ivf(spark, sf_dir, lists=(16,))
    return _rounded(index.search(query_vector(df), 1000000, [16], radius=1.3), "distance")


@query(f"select vec_id as id, round(d, 6) + 0 as distance from (select vec_id, {_D['l2']} as d from e, q where vec_id % 3 <> 1) order by d, vec_id limit 10")
def ivf_delete_vacuum(spark, sf_dir):
    """Insert in two parts, delete a third, vacuum, search."""
    df = embeddings(spark, sf_dir)
    index = IvfIndex.build(df.where("vec_id % 2 = 0"), scratch_path(spark, "ivf"), IvfOptions(lists=(8,)))
    index.insert(df.where("vec_id % 2 = 1"))
    index.delete(df.where("vec_id % 3 = 1").select("vec_id"))
    return _rounded(index.vacuum(scratch_path(spark, "ivf")).search(query_vector(df), 10, [8], bounds=False), "distance")


@query(f"select vec_id as id, round(d, 6) + 0 as distance from (select vec_id, {_D['l2']} as d from e, q) order by d, vec_id limit 10")
def ivf_external_centroids(spark, sf_dir):
    """Label means as the centroid table."""
    df = embeddings(spark, sf_dir)
    table = centroids_of(df).select("id", F.lit(None).cast("long").alias("parent"), "vector")
    index = IvfIndex.build(df, scratch_path(spark, "ivf"), IvfOptions(), centroids=table)
    return _rounded(index.search(query_vector(df), 10, [len(index.levels[0][0])], bounds=False), "distance")


@query(f"select vec_id as id, round(d, 6) + 0 as distance from (select vec_id, case when vec_id % 5 = 2 then sqrt(list_sum(list_transform(range(1, 65), lambda i: (-v[i] - qv[i]) ** 2))) else list_distance(v, qv) end as d from e, q where vec_id % 7 <> 3) order by d, vec_id limit 10")
def ivf_update_topk(spark, sf_dir):
    """Deleted ids that come back with other vectors, in an index that was closed and opened; others stay away."""
    df = embeddings(spark, sf_dir).where("embedding is not null")
    path = scratch_path(spark, "ivf")
    index = IvfIndex.build(df, path, IvfOptions(lists=(8,)))
    index.delete(df.where("vec_id % 5 = 2 or vec_id % 7 = 3").select("vec_id"))
    index.insert(df.where("vec_id % 5 = 2 and vec_id % 7 <> 3").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding")))
    return _rounded(IvfIndex.open(spark, path).search(query_vector(df), 10, [8], bounds=False), "distance")


#: Of 32 lists, so many hold nine of ten true neighbours: unclustered vectors of 64 dimensions spread over most lists.
IVF_PROBES = [27]


# Recall: every vector whose id is divisible by 50 against all vectors.

def _asked(df: DataFrame) -> DataFrame:
    return df.where("vec_id % 50 = 0 and embedding is not null")


def _recall_of(found: DataFrame, df: DataFrame, k: int) -> DataFrame:
    """(enough): whether ``found`` (query_id, id) holds at least 0.9 of the k nearest of each asked vector, taken together."""
    exact = nearest_join(_asked(df), df, k).select("query_id", F.col("neighbor_id").alias("id"))
    both = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg((F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count("*")).alias("enough"))


@query("select true as enough")
def ivf_recall(spark, sf_dir):
    df, index = _ivf(spark, sf_dir, lists=(32,), residual_quantization=True)
    return _recall_of(index.search_many(_asked(df), 10, IVF_PROBES), df, 10)


@query("select true as enough")
def graph_recall(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    index = GraphIndex.build(df, scratch_path(spark, "graph"), GraphOptions(m=16), parts=4)
    return _recall_of(index.search_many(_asked(df), 10), df, 10)


@query("select true as enough")
def rabitq8_recall(spark, sf_dir):
    """The nearest by 8-bit codes alone, for the vector of vec_id 0: nine of the ten nearest are among the first twelve."""
    df = embeddings(spark, sf_dir)
    q = query_vector(df)
    near = top_k(df, q, 10).select("vec_id")
    found = Q.quantized_top_k(df, q, 12).select(F.col("id").alias("vec_id"))
    return near.join(found, "vec_id", "left_semi").agg((F.count("*") >= 9).alias("enough"))


@query()
def ivf_topk(spark, sf_dir):
    df, index = _ivf(spark, sf_dir, lists=(32,), residual_quantization=True)
    return _rounded(index.search(query_vector(df), 10, IVF_PROBES), "distance")


@query()
def graph_topk(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    index = GraphIndex.build(df, scratch_path(spark, "graph"), GraphOptions(m=16), parts=4)
    return _rounded(index.search(query_vector(df), 10), "distance")


# Quantization

def _roundtrip(bits: int):
    def run(spark, sf_dir):
        df = embeddings(spark, sf_dir).where("embedding is not null")
        coded = df.select("vec_id", "embedding", Q.quantize("embedding", bits).alias("c"))
        return coded.select("vec_id", F.round(D.l2("embedding", Q.dequantize("c", bits)), 6).alias("error"))

    return run


_QUERIES["rabitq8_roundtrip"], _QUERIES["rabitq4_roundtrip"] = _roundtrip(8), _roundtrip(4)


def _code_errors(bits: int, bound: float):
    def run(spark, sf_dir):
        """Whether distances on codes are as near to the exact ones as their width allows."""
        df = embeddings(spark, sf_dir).where("embedding is not null")
        v = D.vector(query_vector(df))
        coded = df.select("vec_id", "embedding", Q.quantize("embedding", bits).alias("c"), Q.quantize(v, bits).alias("q"))
        out = coded.select("vec_id", "embedding", *[Q.code_distance(m, "c", "q", bits).alias(m) for m in ("l2", "ip", "cosine")])
        exact = {"l2": D.l2("embedding", v), "ip": D.negative_inner_product("embedding", v), "cosine": D.cosine("embedding", v) - 1}
        # Near the query itself the root of a small difference is coarse, so squares are compared.
        squares = F.abs(F.pow("l2", F.lit(2)) - F.pow(exact["l2"], F.lit(2)))
        return out.select("vec_id", (squares < 2 * bound).alias("l2_near"), (F.abs(F.col("ip") - exact["ip"]) < bound).alias("ip_near"), (F.abs(F.col("cosine") - exact["cosine"]) < bound).alias("cosine_near"))

    return run


_NEAR = "select vec_id, true as l2_near, true as ip_near, true as cosine_near from e"
for _bits, _bound in ((8, 0.02), (4, 0.2)):
    _QUERIES[f"rabitq{_bits}_distances"], _ORACLE[f"rabitq{_bits}_distances"] = _code_errors(_bits, _bound), _COMMON + _NEAR


def _sphere(bits: int | None, radius: float):
    def run(spark, sf_dir):
        """A sphere on codes (or halves) holds what lies well inside it and nothing that lies well outside."""
        df = embeddings(spark, sf_dir).where("embedding is not null")
        v = D.vector(query_vector(df))
        if bits is None:
            found = df.select("vec_id", D.l2(Q.to_half("embedding"), Q.to_half(v)).alias("d"), D.l2("embedding", v).alias("x")).withColumn("inside", F.col("d") < radius)
        else:
            coded = df.select("vec_id", D.l2("embedding", v).alias("x"), Q.quantize("embedding", bits).alias("c"), Q.quantize(v, bits).alias("q"))
            found = coded.select("vec_id", "x", Q.code_within("l2", "c", "q", radius, bits).alias("inside"))
        return found.select("vec_id", ((F.abs(F.col("x") - radius) < 0.15) | (F.col("inside") == (F.col("x") < radius))).alias("agrees"))

    return run


for _name, _bits in (("half", None), ("rabitq8", 8), ("rabitq4", 4)):
    _QUERIES[f"{_name}_sphere"], _ORACLE[f"{_name}_sphere"] = _sphere(_bits, 1.3), _COMMON + "select vec_id, true as agrees from e"


@query()
def rabitq8_topk(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return _rounded(Q.quantized_top_k(df, query_vector(df), 10), "distance")


@query()
def rabitq4_range(spark, sf_dir):
    df = embeddings(spark, sf_dir).where("embedding is not null")
    coded = df.select("vec_id", Q.quantize("embedding", 4).alias("c"), Q.quantize(D.vector(query_vector(df)), 4).alias("q"))
    return _rounded(coded.select("vec_id", Q.code_distance("l2", "c", "q", 4).alias("distance")).where("distance < 1.3"), "distance")


_HALF = "list_transform({v}, lambda x: case when x = 0 then 0.0 else round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) end)"


@query(f"select vec_id, round(d, 6) + 0 as distance from (select vec_id, list_distance({_HALF.format(v='v')}, {_HALF.format(v='qv')}) as d from e, q) order by d, vec_id limit 10")
def halfvec_l2_topk(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    q = np.asarray(query_vector(df)).astype("<f2").astype(float)
    return _rounded(top_k(df.where("embedding is not null").select("vec_id", Q.to_half("embedding").alias("embedding")), q, 10).select("vec_id", "distance"), "distance")


@query("""
    , n as (select count(*) as t, ceil(count(*) / 8) as docs from embeddings), w as (
        select 'exact' as way, 1 as jobs, t * 64 * 4 as bytes_read, 0.0 as bytes_shuffled, t * 64 * 4 as products, 0 as estimates from n
        union all select 'coarse', 3, 3 * t * 64 * 4, 0, least(32, docs) / docs * t * 64 * 4, 2 * t * 64 * 4 from n
        union all select 'indexed', 3, (2 * (1 - pow(0.75, 4)) * 4.125 + 4) * t * 64, t / 4 * 4 * 20, least(32, docs) / docs * t * 64 * 4, 2 * t / 4 * 64 * 4 from n
    )
    select way, jobs, round(cast(bytes_read as double), 3) as bytes_read, round(cast(bytes_shuffled as double), 3) as bytes_shuffled, round(cast(products as double), 3) as products, round(cast(estimates as double), 3) as estimates from w
""")
def maxsim_cost_estimates(spark, sf_dir):
    """What each way of a late-interaction search would read, shuffle and compute on this table."""
    n = embeddings(spark, sf_dir).count()
    corpus, options = cost.Corpus(-(-n // 8), n, 64), M.CoarseOptions(refine=64, candidate_limit=32, backend="auto")
    found = [cost.work(w, corpus, 4, options, 0.25) for w in cost.WAYS]
    rows = [(w.way, w.jobs, *(round(float(x), 3) for x in (w.bytes_read, w.bytes_shuffled, w.products, w.estimates))) for w in found]
    return spark.createDataFrame(rows, "way string, jobs int, bytes_read double, bytes_shuffled double, products double, estimates double")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
