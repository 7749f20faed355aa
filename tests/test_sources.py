from __future__ import annotations

import pytest

from spherion.operators.ivf import IvfIndex, IvfOptions
from spherion.plans.scratch import scratch_path
from spherion.sources.registry import Registry, registered_search, tensor_rerank
from spherion.sources.tensors import TensorStore, descriptor_problem, descriptors
from spherion.streaming.ingest import stream_into

GOOD = ("sha256://x", 2, 2, "float16", "sha256:" + "0" * 64)


@pytest.mark.parametrize("at, value", [(0, ""), (0, "a\nb"), (0, "x" * 5000), (1, 0), (1, 65537), (2, 60001), (3, "int8"), (4, "sha256:" + "A" * 64)])
def test_descriptor_problems(spark, at, value):
    wrong = [tuple(bad if k == at else v for k, v in enumerate(GOOD)) for bad in (value, None)]
    df = spark.createDataFrame([GOOD, *wrong], "tensor_ref string, tensor_rows int, tensor_dim int, tensor_dtype string, tensor_checksum string")
    good, *bad = [r[0] for r in df.select(descriptor_problem()).collect()]
    assert good is None and all(bad)


@pytest.fixture
def source(spark):
    docs = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]], "m"), (2, [[0.5, 0.0]], "m"), (3, [[0.5, 0.0]], "m"), (4, [[9.0, 9.0]], "other")], "doc_id long, tokens array<array<float>>, contract string")
    docs.createOrReplaceTempView("src_docs")
    described = descriptors(docs)
    described.drop("payload").withColumnRenamed("id", "source_id").createOrReplaceTempView("src_desc")
    store = TensorStore(spark, scratch_path(spark, "store"))
    store.publish(described)
    registry = Registry(spark)
    registry.register("s", "src_docs", "doc_id", "contract", "  m ", "EXTERNAL_RELATION", descriptor_relation="src_desc", descriptor_id="source_id")
    return docs, described, store, registry


def test_registry(spark, source):
    _, _, _, registry = source
    row = registry.info().first()
    assert (row["model_contract"], row["storage"]) == ("m", "external_relation")
    for change in (dict(public_id="contract"), dict(model_contract=" "), dict(storage="other"), dict(relation="nowhere"), dict(descriptor_id="tensor_ref")):
        given = dict(relation="src_docs", public_id="doc_id", contract_column="contract", model_contract="m", storage="external_relation", descriptor_relation="src_desc", descriptor_id="source_id") | change
        with pytest.raises(ValueError):
            registry.register("bad", **given)
    spark.catalog.dropTempView("src_desc")
    with pytest.raises(ValueError):
        registry.resolve("s")
    assert registry.unregister("s") and not registry.unregister("s")


def test_store_is_idempotent_and_verified(spark, source):
    docs, described, store, registry = source
    store.publish(described)
    assert store._rows().count() == 3  # equal tensors are stored once
    assert store.resolve(registry.described("s", True)).count() == 3
    small = store.collect_garbage(described.where("id = 1"), scratch_path(spark, "store"))
    assert small._rows().count() == 1
    with pytest.raises(Exception, match="missing or damaged"):
        small.resolve(registry.described("s", True)).collect()


def test_rerank_and_search(spark, source):
    docs, _, store, registry = source
    got = [tuple(r) for r in tensor_rerank(registry, store, "s", [[1.0, 0.0], [0.0, 1.0]], [3, 2, 1, 4], 4).collect()]
    assert got == [(1, 2.0), (2, 0.5), (3, 0.5)]
    # a document under another contract neither appears nor uses up the limit
    assert [r[0] for r in registered_search(registry, store, "s", docs, [[1.0, 0.0]], 2, 2).collect()] == [1, 2]
    registry.register("heap", "src_docs", "doc_id", "contract", "m", "heap_array", tensor_column="tokens")
    assert [tuple(r) for r in registered_search(registry, None, "heap", docs, [[1.0, 0.0]], 2, 2).collect()] == [(1, 1.0), (2, 0.5)]
    assert [tuple(r) for r in tensor_rerank(registry, None, "heap", [[1.0, 0.0]], [2, 4], 2).collect()] == [(2, 0.5)]
    mine = docs.where("contract = 'm'")
    assert [r[0] for r in registered_search(registry, store, "s", mine, [[1.0, 0.0]], 3, 2).collect()] == [1, 2]
    spark.table("src_desc").where("source_id <> 2").createOrReplaceTempView("src_desc2")
    registry.register("gap", "src_docs", "doc_id", "contract", "m", descriptor_relation="src_desc2", descriptor_id="source_id")
    with pytest.raises(Exception, match="bad tensor descriptor"):
        registered_search(registry, store, "gap", mine, [[1.0, 0.0]], 3, 3).collect()
    assert tensor_rerank(registry, store, "gap", [[1.0, 0.0]], [1, 2], 2).count() == 1
    for ids, k in (([], 1), ([1, 1], 1), ([1], 2)):
        with pytest.raises(ValueError):
            tensor_rerank(registry, store, "s", [[1.0, 0.0]], ids, k)


def test_stream(spark, tmp_path):
    base = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    index = IvfIndex.build(base, scratch_path(spark, "ivf"), IvfOptions())
    spark.createDataFrame([(2, [0.0, 1.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = stream_into(index, spark.readStream.schema("vec_id long, embedding array<double>").parquet(str(tmp_path / "in")), str(tmp_path / f"c{_}"), once=True)
        q.awaitTermination()
    assert sorted(r["id"] for r in index.rows().collect()) == [1, 2, 3]
