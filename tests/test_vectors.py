from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spherion import catalog
from spherion.functions import distance as D
from spherion.functions import kmeans, rabitq
from spherion.operators import maxsim as M
from spherion.operators import quantized as Q
from spherion.operators.graph import GraphIndex, GraphOptions, robust_prune
from spherion.operators.ivf import IvfIndex, IvfOptions, checked_probes
from spherion.operators.recall import QuerySampler, query_recall, recall
from spherion.operators.topk import knn_join, range_search, top_k
from spherion.plans import cost, planner
from spherion.plans.planner import Settings, choose
from spherion.plans.scratch import scratch_path


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


# Distances

@pytest.mark.parametrize("metric, want", [("l2", 1.732), ("ip", -20.0), ("cosine", 0.007)])
def test_golden_distances(spark, metric, want):
    a, b = D.vector([1, 2, 3]), D.vector([2, 3, 4])
    assert round(one(spark, D.distance(metric, a, b)), 3) == want
    assert round(one(spark, D.distance(metric, Q.to_half(a), Q.to_half(b))), 3) == want


def test_dimension_and_nulls(spark):
    with pytest.raises(Exception, match="dimension is not matched"):
        one(spark, D.l2(D.vector([1]), D.vector([1, 2])))
    assert one(spark, D.l2(F.lit(None).cast("array<float>"), D.vector([1]))) is None
    assert math.isnan(one(spark, D.cosine(D.vector([0, 0]), D.vector([1, 0]))))


def test_range_is_strict(spark):
    df = spark.createDataFrame([(i, [v] * 3) for i, v in enumerate((0.1, 0.2, 0.3, 0.4))], "vec_id long, embedding array<float>")
    assert sorted(r["vec_id"] for r in range_search(df, [0.24] * 3, 0.12).collect()) == [1, 2]
    line = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert range_search(line, [0.0], 1.0).count() == 0 and range_search(line, [0.0], 1.0001).count() == 1
    ball = D.sphere(D.vector([0.24] * 3), 0.12)
    assert sorted(r["vec_id"] for r in df.where(D.within("l2", "embedding", ball)).collect()) == [1, 2]


def test_null_vectors_and_null_query(spark):
    df = spark.createDataFrame([(0, None), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in top_k(df, [0.0, 0.0], 5).collect()] == [1]
    assert top_k(df, None, 5).count() == 0


def test_sparse_and_bits(spark):
    a = F.create_map(F.lit(1), F.lit(2.0), F.lit(5), F.lit(1.0))
    b = F.create_map(F.lit(1), F.lit(3.0), F.lit(6), F.lit(1.0))
    assert one(spark, D.sparse_dot(a, b)) == 6.0
    assert one(spark, D.sparse_combine(a, b, "sub")) == {1: -1.0, 5: 1.0, 6: -1.0}
    assert one(spark, D.sparse_combine(a, b, "mul")) == {1: 6.0}
    x, y = F.array(F.lit(0b1100).cast("long")), F.array(F.lit(0b1010).cast("long"))
    assert (one(spark, D.hamming(x, y)), one(spark, D.bit_dot(x, y))) == (2, -1)
    assert abs(one(spark, D.jaccard(x, y)) - 2 / 3) < 1e-12


# Deterministic data of the reference's tests

def md5_vectors() -> np.ndarray:
    out = np.empty((2048, 64))
    for i in range(1, 2049):
        for j in range(1, 65):
            h = int(hashlib.md5(str(64 * i + j).encode()).hexdigest()[:16], 16)
            out[i - 1, j - 1] = (h - (1 << 64) if h >> 63 else h) / 18446744073709551615.0
    return out / np.sqrt((out * out).sum(1, keepdims=True))


@pytest.fixture(scope="module")
def md5():
    return md5_vectors()


@pytest.fixture(scope="module")
def md5_table(spark, md5):
    return spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(md5)], "vec_id long, embedding array<double>").cache()


EXACT = [1608, 155, 1643, 174, 818, 1603, 1629, 60, 218, 1080]
QUERY = [0.6, 0.8] + [0.0] * 62


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_deterministic_top_ten(md5_table, metric):
    assert [r["vec_id"] for r in top_k(md5_table, QUERY, 10, metric).collect()] == EXACT


def test_coarse_maxsim_golden(spark, md5):
    docs = spark.createDataFrame([(i + 1, [v.tolist()] * 2) for i, v in enumerate(md5)], "doc_id long, tokens array<array<double>>")
    query = [QUERY, [x / 2 for x in QUERY]]
    got = [r["id"] for r in M.maxsim_search(docs, query, 10).collect()]
    assert got == [1207, 919, 1639, 1821, 174, 79, 1076, 1125, 239, 194]
    assert [r["id"] for r in M.maxsim_top_k(docs, query, 3).collect()] == EXACT[:3]


def test_indexes(spark, md5_table):
    index = IvfIndex.build(md5_table, scratch_path(spark, "ivf"), IvfOptions(lists=(32,)))
    assert [r["id"] for r in index.search(QUERY, 10, "32", bounds=False).collect()] == EXACT
    assert index.search(QUERY, 10, "0").count() == 0
    with pytest.raises(ValueError, match="probes"):
        index.search(QUERY, 10, "1,2")
    few, many = (query_recall(index, QUERY, 10, p) for p in ("4", "32"))
    assert few <= many and many >= 0.9
    graph = GraphIndex.build(md5_table.where("vec_id <= 600"), scratch_path(spark, "graph"), GraphOptions(m=16), parts=2)
    truth = top_k(md5_table.where("vec_id <= 600"), QUERY, 10).select("vec_id")
    assert recall(graph.search(QUERY, 10, ef_search=128).select("id"), truth) >= 0.8
    kept = graph.maintain(scratch_path(spark, "graph"), deleted=truth.limit(1))
    assert kept.rows().count() == 599
    assert "32 nodes" in index.prewarm()


def test_ivf_change_and_external(spark, md5_table):
    some = md5_table.where("vec_id <= 300")
    index = IvfIndex.build(some, scratch_path(spark, "ivf"), IvfOptions(lists=(4,), metric="cosine", residual_quantization=True))
    index.delete(some.where("vec_id <= 100").select("vec_id"))
    assert index.rows().count() == 200
    index.insert(spark.createDataFrame([(9999, QUERY), (9998, None)], "vec_id long, embedding array<double>"))
    assert [r["id"] for r in index.search(QUERY, 1, "4").collect()] == [9999]
    assert index.vacuum(scratch_path(spark, "ivf")).rows().count() == 201
    table = lambda rows: spark.createDataFrame(rows, "id long, parent long, vector array<double>")
    unit = np.eye(3).tolist()
    small = spark.createDataFrame([(k, v) for k, v in enumerate(unit)], "vec_id long, embedding array<double>")
    build = lambda rows: IvfIndex.build(small, scratch_path(spark, "ivf"), centroids=table(rows))
    assert len(build([(k, None, v) for k, v in enumerate(unit)]).levels) == 1
    assert len(build([(0, None, [0.0] * 3), (1, 0, unit[0]), (2, 0, unit[1]), (3, 1, unit[0]), (4, 2, unit[1])]).levels) == 2
    for rows, why in (([(1, None, unit[0]), (1, None, unit[1])], "duplicate"), ([(1, None, [1.0])], "dimension"), ([(1, 7, unit[0])], "missing parent"), ([(0, None, unit[0]), (1, None, unit[1]), (2, 0, unit[0])], "one root"), ([(0, None, unit[0]), (1, 0, unit[0]), (2, 0, unit[1]), (3, 1, unit[0])], "unequal height"), ([(0, None, unit[0]), (1, 2, unit[0]), (2, 1, unit[1]), (3, 0, unit[2])], "cycle")):
        with pytest.raises(ValueError, match=why):
            build(rows)


def test_options():
    assert IvfOptions.from_toml("residual_quantization = true\n[build.internal]\nlists = [2, 4]").lists == (2, 4)
    for text in ("unknown = 1", "[build.internal]\nlists = [4, 2]", "degree_of_parallelism = 0"):
        with pytest.raises(ValueError):
            IvfOptions.from_toml(text)
    assert checked_probes("1, 2", 2) == [1, 2]
    own = Settings(probes="8")
    assert own.under(probes="2").probes == "2" and own.under().probes == "8" and Settings().epsilon == 1.9
    with pytest.raises(ValueError):
        own.under(epsilon=5.0)
    assert choose(None, 10, own, True) == "flat"


# MaxSim

CASES = [[[1.0, 0.0], [0.0, 1.0]], [[0.8, 0.0], [0.0, 0.8]], [[1.0, 0.0]], [[0.0, 0.0]]]


def test_maxsim_ranking_and_limits(spark):
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(CASES)], "doc_id long, tokens array<array<double>>")
    query = [[1.0, 0.0], [0.0, 1.0]]
    got = [(r["id"], round(r["distance"], 3)) for r in M.maxsim_top_k(docs, query, 4).collect()]
    assert got == [(1, -2.0), (2, -1.6), (3, -1.0), (4, 0.0)]
    cut = M.maxsim_search(docs, query, 4, M.CoarseOptions(refine=8, candidate_limit=2, backend="gpu"))
    assert [r["id"] for r in cut.collect()] == [1, 2]
    with pytest.raises(ValueError, match="candidate_limit"):
        M.maxsim_search(docs, query, 4, M.CoarseOptions(backend="cpu_exact"))
    for ids, k in (([], 1), ([1, 1], 1), ([1, None], 1), ([1], 2), ([1], 0)):
        with pytest.raises(ValueError):
            M.rerank_ids(docs, query, ids, k)


def test_maxsim_is_asymmetric(spark):
    one_token, two = [[1.0, 0.0]], [[1.0, 0.0], [1.0, 0.0]]
    lit = lambda t: F.array(*[D.vector(v) for v in t])
    assert one(spark, M.maxsim_distance(lit(one_token), lit(two))) == -2.0
    assert one(spark, M.maxsim_distance(lit(two), lit(one_token))) == -1.0


@pytest.mark.parametrize("rows, why", [([], "empty"), (None, "empty"), ([[1.0], None], "NULL"), ([[1.0], [1.0, 2.0]], "dimension"), ([[1.0]] * 65537, "65536")])
def test_maxsim_input_errors(rows, why):
    with pytest.raises(ValueError, match=why):
        M.checked_tensor(rows)


def test_unit_circle_order(spark):
    docs = []
    for i in range(1, 3001):
        docs.append((i, [[math.sin(i + o), math.cos(i + o)] for o in (0, 22, 777)]))
    df = spark.createDataFrame(docs, "doc_id long, tokens array<array<double>>")
    q = [[0.0, 1.0], [1.0, 0.0]]
    want = sorted((sum(min(-(t[0] * x[0] + t[1] * x[1]) for t in d) for x in q), i) for i, d in docs)[:18]
    assert [r["id"] for r in M.maxsim_top_k(df, q, 18).collect()] == [i for _, i in want]


def test_merge():
    assert M.merge_top_k([[(3, 30), (1, 20)], [(1, 10), (2, 40), (0, 50)]], 3) == [(0, 50), (1, 10), (1, 20)]


# Quantization

def test_rotation():
    assert np.allclose(rabitq.rotate([2, 3, 4])[0], (3.981917, 1.8043789, 3.1446066), atol=1e-6)
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 64, 100):
        x = r.normal(size=(4, n))
        assert np.allclose(rabitq.rotate_back(rabitq.rotate(x)), x) and np.allclose((rabitq.rotate(x) ** 2).sum(1), (x**2).sum(1))
    signs = rabitq.sign_passes()[0, :64]
    assert np.packbits(signs < 0, bitorder="little").tolist() == [246, 133, 163, 106, 54, 126, 9, 115]


@pytest.mark.parametrize("bits, bound", [(8, 0.07), (4, 1.0)])
def test_dequantize(spark, bits, bound):
    v = D.vector(range(1, 9))
    code = Q.quantize(v, bits)
    assert one(spark, D.l2(v, Q.dequantize(code, bits))) < bound
    assert one(spark, D.l2(v, Q.dequantize(code, bits, to_half=True))) < bound


def test_code_distances_approach_exact():
    r = np.random.default_rng(2)
    x, y = r.normal(size=(50, 32)), r.normal(size=(50, 32))
    a, b = rabitq.quantize(x, 8), rabitq.quantize(y, 8)
    assert np.allclose(rabitq.code_distance("l2", 8, a, b), np.sqrt(((x - y) ** 2).sum(1)), rtol=0.02)
    cosine = (x * y).sum(1) / np.sqrt((x**2).sum(1) * (y**2).sum(1))
    assert np.allclose(rabitq.code_distance("cosine", 8, a, b), -cosine, atol=0.02)


def test_bounds_hold_mostly():
    r = np.random.default_rng(3)
    x, q = r.normal(size=(2000, 64)), r.normal(size=64)
    signs, factors = rabitq.binary_code(rabitq.rotate(x))
    exact, rotated = ((x - q) ** 2).sum(1), rabitq.rotate(q)[0]
    held = [float((rabitq.lower_bound("l2", signs, factors, rotated, e) <= exact).mean()) for e in (0.8, 1.9, 3.0)]
    assert held == sorted(held) and held[1] >= 0.95


def test_code_text_and_bytes():
    code, factors = rabitq.quantize(np.arange(1.0, 8.0)[None], 4)
    row = {f: float(np.float32(v[0])) for f, v in factors.items()}
    assert rabitq.parse_code(rabitq.format_code(row, code[0]), 4)[1].tolist() == code[0].tolist()
    back = rabitq.receive_code(rabitq.send_code(row, code[0], 4), 4)
    assert back[1].tolist() == code[0].tolist() and back[0] == row
    for text in ("", "(1,2,3)[1]", "(1,2,3,4)[]", "(1,2,3,4)[16]"):
        with pytest.raises(ValueError):
            rabitq.parse_code(text, 4)


def test_code_maxsim(spark):
    d = spark.createDataFrame([(1, [[1.0, 0.2, 0.3], [0.1, 1.0, 0.0]])], "id long, t array<array<double>>")
    pieces = d.select(F.posexplode("t").alias("i", "v")).select("i", Q.quantize("v").alias("c")).groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("x")).select(F.transform("x", lambda t: t["c"]).alias("c"))
    got = pieces.select(Q.code_maxsim("c", "c").alias("x")).first()[0]
    assert abs(got - M.maxsim(np.array([[1.0, 0.2, 0.3], [0.1, 1.0, 0.0]]), np.array([[1.0, 0.2, 0.3], [0.1, 1.0, 0.0]]))) < 0.05


# k-means, graph, joins, sampler, cost

def test_kmeans():
    r = np.random.default_rng(4)
    x = np.vstack([r.normal(c, 0.05, (50, 8)) for c in (-1, 0, 1)])
    for algorithm in ("lloyd", "hierarchical"):
        c = kmeans.train(x, 3, algorithm=algorithm)
        assert c.shape == (3, 8)
    assert np.allclose((kmeans.train(x, 3, spherical=True) ** 2).sum(1), 1)
    assert kmeans.train(x, 3, dimension=2).shape == (3, 8)
    with pytest.warns(UserWarning):
        kmeans.train(x, 3, dimension=8)
    assert len(kmeans.lloyd(x[:2], 5)) == 5
    assert kmeans.assign(np.zeros((1, 2)), np.zeros((3, 2))).tolist() == [2]
    assert kmeans.seats(np.array([10.0, 1.0]), 5).sum() == 5


def test_prune_uses_slack_for_l2_only():
    x = np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 5]])
    assert robust_prune("l2", x, 0, np.array([1, 2, 3]), 2, (1.0,)).tolist() == [1, 3]
    assert len(robust_prune("ip", x, 0, np.array([1, 2, 3]), 3, (1.0, 1.2))) == 3


def test_knn_join_grid(spark, monkeypatch):
    from spherion.operators import topk

    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(60, 4)))], "vec_id long, embedding array<double>")
    plain = sorted(map(tuple, knn_join(df, df, 3).collect()))
    monkeypatch.setattr(topk, "QUERY_BYTES", 500)
    assert [p[:2] for p in sorted(map(tuple, knn_join(df, df, 3).collect()))] == [p[:2] for p in plain]


def test_knn_join_grid_over_many_partitions(spark, monkeypatch):
    """Cells meet their other side wherever they are dealt: the keys of both sides hash alike."""
    from spherion.operators import topk

    r = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(90, 4)))], "vec_id long, embedding array<double>")
    base = df.where("vec_id < 40")
    plain = sorted(map(tuple, knn_join(df, base, 2).collect()))
    assert len(plain) == 180
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    monkeypatch.setattr(topk, "QUERY_BYTES", 500)
    monkeypatch.setattr(topk, "BLOCK", 50)
    try:
        for size in (topk.BASE_BYTES, 400):
            monkeypatch.setattr(topk, "BASE_BYTES", size)
            assert [p[:2] for p in sorted(map(tuple, knn_join(df, base, 2).collect()))] == [p[:2] for p in plain]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_sampler_and_recall(spark):
    log = QuerySampler(spark, scratch_path(spark, "log"), rate=1.0, max_records=2, seed=1)
    assert all(log.record("a", [float(k), 1.0]) for k in range(3)) and log.record("b", [9.0])
    assert log.sampled_values("a").count() == 2 and log.sampled_queries().count() == 3
    log.drop("a", scratch_path(spark, "log"))
    assert [r["index"] for r in log.sampled_queries().collect()] == ["b"]
    assert not QuerySampler(spark, "unused", rate=0.0, max_records=5).record("a", [1.0])
    empty = spark.range(0)
    assert math.isnan(recall(empty, empty)) and recall(spark.range(5), spark.range(10)) == 0.5


def test_cost_properties():
    corpus, options = cost.Corpus(34054, 25438338, 320), M.CoarseOptions(refine=64, candidate_limit=256, backend="auto")
    for way in cost.WAYS:
        w = cost.work(way, corpus, 32, options, 0.01)
        assert 0 < w.seconds(64) < w.seconds(8) and math.isfinite(w.seconds(0))
        assert cost.work(way, corpus, 64, options, 0.01).seconds(8) > w.seconds(8)
        assert math.isfinite(cost.work(way, cost.Corpus(0, 0, 1), 1, options).seconds(1))
    narrow, wide = (cost.work("indexed", corpus, 32, M.CoarseOptions(candidate_limit=n, backend="auto"), 0.01) for n in (128, 2048))
    assert narrow.products < wide.products
    assert cost.work("coarse", corpus, 32).products == 0 < cost.work("coarse", corpus, 32, options).products
    assert cost.cheapest(corpus, 32, 8, options) == "exact"
    only = M.CoarseOptions(candidate_limit=256)
    assert cost.cheapest(cost.Corpus(1e9, 1e11, 128), 32, 8000, only, 1e-4) == "indexed"
    for bad in (lambda: cost.work("gpu", corpus, 1), lambda: cost.work("exact", corpus, 0), lambda: cost.Corpus(-1, 0, 1)):
        with pytest.raises(ValueError):
            bad()


def test_planned_searches(spark):
    r = np.random.default_rng(12)
    rows = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    index, q = IvfIndex.build(rows, scratch_path(spark, "ivf"), IvfOptions(lists=(8,))), r.normal(size=8).tolist()
    exact = [x["vec_id"] for x in planner.search(rows, q, 5).collect()]
    assert [x["vec_id"] for x in planner.search(rows, q, 5, Settings(probes="7"), index).collect()][0] == exact[0]
    assert choose(index, 200, Settings(probes="2"), True) == "index" and choose(index, 200, Settings(probes="2", enable_scan=False), True) == "flat"
    docs = spark.createDataFrame([(i, r.normal(size=(3, 8)).tolist()) for i in range(60)], "doc_id long, tokens array<array<double>>")
    tokens = IvfIndex.build(M.token_rows(docs), scratch_path(spark, "ivf"), IvfOptions(lists=(4,), metric="ip"))
    t = r.normal(size=(2, 8)).tolist()
    way, found = planner.maxsim_search(docs, t, 5, Settings(maxsim_backend="auto", maxsim_candidate_limit=20))
    assert way == "exact" and [x["id"] for x in found.collect()] == [x["id"] for x in M.maxsim_top_k(docs, t, 5).collect()]
    assert planner.maxsim_search(docs, t, 5)[0] == "coarse"
    way, found = planner.maxsim_search(docs, t, 5, Settings(probes="2"), tokens)
    assert way == "indexed" and found.count() == 5


def test_checked_dimension(spark):
    assert one(spark, D.checked_dimension(D.vector([1, 2]), 2)) == [1.0, 2.0]
    with pytest.raises(Exception, match="expected 3 dimensions, not 2"):
        one(spark, D.checked_dimension(D.vector([1, 2]), 3))
    with pytest.raises(ValueError):
        D.checked_dimension(D.vector([1]), 0)


def test_profile(spark):
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(CASES)], "doc_id long, tokens array<array<double>>")
    rows, profile = M.profiled_search(docs, [[1.0, 0.0], [0.0, 1.0]], 2, M.CoarseOptions(refine=8, candidate_limit=3, backend="auto"))
    assert [i for i, _ in rows] == [1, 2] and (profile["documents"], profile["document_tokens"], profile["candidates"]) == (4, 6, 3)


@pytest.mark.parametrize("refine, held", [(0, 1 << 18), (5, 1 << 18), (5, 12), (40, 12), (10000, 1 << 18)])
def test_refined_candidates_against_brute_force(spark, monkeypatch, refine, held):
    monkeypatch.setattr(M, "HELD_TOKENS", held)
    monkeypatch.setattr(M, "BLOCK_NUMBERS", 64)
    r = np.random.default_rng(9)
    docs = [(i, r.normal(size=(1 + i % 4, 8)).tolist()) for i in range(60)]
    docs[7:9] = [(7, docs[6][1]), (8, None)]
    q = r.normal(size=(3, 8))
    df = spark.createDataFrame([*docs, (None, docs[0][1])], "doc_id long, tokens array<array<double>>").repartition(3)
    tokens = [(i, p, np.array(t)) for i, d in docs if d for p, t in enumerate(d)]
    signs, factors = rabitq.binary_code(rabitq.rotate(np.stack([t for _, _, t in tokens])))
    want = {}
    for t, turned in zip(q, rabitq.rotate(q)):
        rough = rabitq.binary_estimate("ip", signs, factors, turned)[0]
        order = sorted(range(len(tokens)), key=lambda n: (round(rough[n], 9), tokens[n][:2]))
        near = set(order[:refine])
        cells = {}
        for n, (i, _, x) in enumerate(tokens):
            cells.setdefault(i, []).append(-(x @ t) if n in near else rough[n])
        for i, c in cells.items():
            want[i] = want.get(i, 0) + min(c)
    got = {x["id"]: x["estimate"] for x in M.coarse_candidates(df, q, M.CoarseOptions(refine=refine)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_search_through_an_index(spark):
    r = np.random.default_rng(10)
    docs = spark.createDataFrame([(i, r.normal(size=(3, 8)).tolist()) for i in range(100)], "doc_id long, tokens array<array<double>>")
    index = IvfIndex.build(M.token_rows(docs), scratch_path(spark, "ivf"), IvfOptions(lists=(4,), metric="ip"))
    q, options = r.normal(size=(2, 8)), M.CoarseOptions(refine=1000, candidate_limit=20, backend="auto")
    exact = [x["id"] for x in M.maxsim_top_k(docs, q, 5).collect()]
    assert [x["id"] for x in M.maxsim_search(docs, q, 5, options, index=index, probes="4").collect()] == exact
    with pytest.raises(ValueError):
        M.maxsim_search(docs, q, 5, options, index=index)


def test_indexed_candidates_fill_gaps(spark):
    r = np.random.default_rng(8)
    docs = [(i, r.normal(size=(3, 8)).tolist()) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<array<double>>")
    q = r.normal(size=(2, 8))
    index = IvfIndex.build(M.token_rows(df), scratch_path(spark, "ivf"), IvfOptions(lists=(8,), metric="ip"))
    exact = [x["id"] for x in M.maxsim_top_k(df, q, 5).collect()]
    full = M.indexed_candidates(index, q, "8", M.CoarseOptions(refine=10000, candidate_limit=5))
    assert [x["id"] for x in full.collect()] == exact
    # By hand: exact distances in probed lists, the worst visited or the bound elsewhere.
    sizes = {x["list_id"]: x["count"] for x in index.rows().groupBy("list_id").count().collect()}
    lists, leaves = [index.probed_lists(t, "2") for t in q], index.levels[-1][0]
    of = {x["id"]: x["list_id"] for x in index.rows().collect()}
    for threshold in (0, 400):
        want = {}
        for k, t in enumerate(q):
            seen = {(i, p): float(-(np.array(d[p]) @ t)) for i, d in docs for p in range(3) if of[i * 65536 + p] in lists[k]}
            gap, covered = max(seen.values()), sum(sizes[x] for x in lists[k])
            for leaf in np.argsort(-(leaves @ t), kind="stable"):
                if covered >= threshold:
                    break
                if leaf not in lists[k]:
                    covered += sizes.get(leaf, 0)
                    gap = max(gap, max(seen.values()), float(-(leaves[leaf] @ t))) if covered >= threshold else max(seen.values())
            for i, d in docs:
                own = [seen[i, p] for p in range(3) if (i, p) in seen]
                want.setdefault(i, []).append((min(own) if own else gap, bool(own)))
        want = {i: sum(v for v, _ in c) for i, c in want.items() if any(s for _, s in c)}
        got = {x["id"]: x["estimate"] for x in M.indexed_candidates(index, q, "2", M.CoarseOptions(refine=10000, threshold=threshold)).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_index_changes_and_opens(spark, tmp_path):
    path = str(tmp_path / "ivf")
    df = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(10)], "vec_id long, embedding array<double>")
    index = IvfIndex.build(df, path, IvfOptions(lists=(2,)))
    index.delete(spark.createDataFrame([(3,), (4,)], "id long"))
    index.insert(spark.createDataFrame([(3, [30.0, 0.0])], "vec_id long, embedding array<double>"))
    for found in (index, IvfIndex.open(spark, path)):
        assert found.options == index.options and found.dim == 2
        assert [(r["id"], r["distance"]) for r in found.search([30.0, 0.0], 2, [2]).collect()] == [(3, 0.0), (9, 21.0)]
        assert found.rows().count() == 9
    index.upsert(spark.createDataFrame([(9, [0.0, 1.0]), (4, [4.0, 0.0])], "vec_id long, embedding array<double>"))
    compact = index.vacuum(str(tmp_path / "compact"))
    assert sorted((r["id"], r["vec"]) for r in IvfIndex.open(spark, compact.path).rows().collect())[-1] == (9, [0.0, 1.0])
    assert compact.rows().count() == 10
    assert IvfIndex.build(df, path, IvfOptions(lists=(2,))).rows().count() == 10
    again = spark.createDataFrame([(70, [7.0, 7.0]), (71, [8.0, 8.0])], "vec_id long, embedding array<double>")
    compact.insert(again.limit(1), once="batch")
    compact.insert(again, once="batch")
    assert compact.rows().where("id >= 70").count() == 2


def test_index_searches_many_at_once(spark, tmp_path, monkeypatch):
    from spherion.operators import ivf

    df = spark.createDataFrame([(k, [float(k % 7), float(k // 7)]) for k in range(60)] + [(99, None)], "vec_id long, embedding array<double>")
    index = IvfIndex.build(df, str(tmp_path / "ivf"), IvfOptions(lists=(4,)))
    for size in (1 << 20, 200):
        monkeypatch.setattr(ivf, "QUERY_BYTES", size)
        got = index.search_many(df.where("vec_id % 10 = 0 or vec_id = 99"), 3, [4]).collect()
        assert len(got) == 18
        for q in (0, 50):
            want = [r["id"] for r in index.search([float(q % 7), float(q // 7)], 3, [4]).collect()]
            assert [r["id"] for r in sorted((x for x in got if x["query_id"] == q), key=lambda x: (x["distance"], x["id"]))] == want
    bare = IvfIndex.build(df, str(tmp_path / "bare"), IvfOptions(lists=(4,), rerank_in_table=True))
    assert bare.rows().where("vec is not null").count() == 0
    with pytest.raises(ValueError):
        bare.search([0.0, 0.0], 3, [4])


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_graphs_search_many_at_once(spark, tmp_path, monkeypatch, metric):
    from spherion.operators import graph

    monkeypatch.setattr(graph, "NODES", 30)
    r = np.random.default_rng(7)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(r.normal(size=(120, 8)))] + [(999, None)], "vec_id long, embedding array<double>")
    index = GraphIndex.build(df, str(tmp_path / "graph"), GraphOptions(metric=metric, m=8), parts=2)
    assert index.rows().count() == 120
    assert spark.read.parquet(index.path).count() == 4  # more than asked for: some NODES rows each
    for size, answers in ((1 << 20, 1024), (200, 2)):
        monkeypatch.setattr(graph, "QUERY_BYTES", size)
        monkeypatch.setattr(graph, "ANSWERS", answers)
        got = index.search_many(df.where("vec_id % 20 = 0 or vec_id = 999"), 5).collect()
        assert len(got) == 30
        for q in df.where("vec_id in (0, 60)").collect():
            want = [(x["id"], round(x["distance"], 9)) for x in index.search(q["embedding"], 5).collect()]
            mine = sorted((x for x in got if x["query_id"] == q["vec_id"]), key=lambda x: (x["distance"], x["id"]))
            assert [(x["id"], round(x["distance"], 9)) for x in mine] == want
    with pytest.raises(ValueError, match="dimension"):
        index.search_many(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"), 5)


def test_graph_recall_asks_many_in_one_plan(spark, tmp_path):
    """Every row is asked: a plan that grows with their number overflows at some two thousand."""
    r = np.random.default_rng(8)
    for name, step, n in (("many", 50, 400), ("none", 50, 0), ("unasked", 1, 30)):
        rows = [(step * k + (step == 1), v.tolist(), 0) for k, v in enumerate(r.normal(size=(n, 4)))]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / name / "embeddings.parquet"))
        df = catalog.queries()["graph_recall"](spark, str(tmp_path / name))
        assert df._jdf.queryExecution().analyzed().collectLeaves().size() < 8
        assert [tuple(x) for x in df.collect()] == [(True,)]


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_prune_by_definition(metric):
    from spherion.operators.graph import _to

    r = np.random.default_rng(9)
    for n, m, alphas in ((1, 4, (1.0,)), (30, 6, (1.0, 1.2)), (70, 40, (1.0, 1.3))):
        x = r.normal(size=(n + 1, 5))
        near = sorted(range(1, n + 1), key=lambda c: _to(metric, x[c : c + 1], x[0])[0])
        want = []
        for alpha in alphas if metric == "l2" else (1.0,):
            for c in near:
                if len(want) < m and c not in want and all(alpha * _to(metric, x[o : o + 1], x[c])[0] > _to(metric, x[c : c + 1], x[0])[0] for o in want):
                    want.append(c)
        want += [c for c in near if c not in want][: m - len(want)]
        assert robust_prune(metric, x, 0, np.array([0, *range(1, n + 1), 1]), m, alphas).tolist() == want
