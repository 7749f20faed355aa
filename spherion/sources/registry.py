"""Registered tensor sources: which relation holds the documents, which the tensors, under which model contract."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spherion.operators.maxsim import MAX_CANDIDATES, CoarseOptions, checked_tensor, coarse_candidates, exact_scores
from spherion.sources.tensors import TensorStore, descriptor_problem, external_scores

STORAGES = ("heap_array", "external_ref", "external_relation")
DESCRIPTOR = ("tensor_ref", "tensor_rows", "tensor_dim", "tensor_dtype", "tensor_checksum")
_KINDS = {"tensor_ref": ("string",), "tensor_rows": ("int", "bigint"), "tensor_dim": ("int", "bigint"), "tensor_dtype": ("string",), "tensor_checksum": ("string",)}


@dataclass(frozen=True)
class Source:
    """``relation`` (a table or view) has ``public_id`` and ``contract_column``; ``descriptor_relation`` joins by ``descriptor_id``."""

    name: str
    relation: str
    public_id: str
    contract_column: str
    model_contract: str
    storage: str = "external_relation"
    tensor_column: str | None = None
    descriptor_relation: str | None = None
    descriptor_id: str | None = None


class Registry:
    """Sources by name, in memory or in a JSON file of the driver; each use validates them again and fails closed."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.sources = spark, path, {}
        if path:
            try:
                with open(path) as file:
                    self.sources = {k: Source(**v) for k, v in json.load(file).items()}
            except FileNotFoundError:
                pass

    def _save(self) -> None:
        if self.path:
            with open(self.path, "w") as file:
                json.dump({k: asdict(s) for k, s in self.sources.items()}, file)

    def register(self, name: str, relation: str, public_id: str, contract_column: str, model_contract: str, storage: str = "external_relation", **rest) -> Source:
        """Adds or replaces; the contract is trimmed, the storage lower-cased."""
        source = Source(name, relation, public_id, contract_column, (model_contract or "").strip(), storage.strip().lower(), **rest)
        self._validate(source)
        self.sources[name] = source
        self._save()
        return source

    def unregister(self, name: str) -> bool:
        found = self.sources.pop(name, None) is not None
        self._save()
        return found

    def info(self) -> DataFrame:
        kinds = "name string, relation string, public_id string, contract_column string, model_contract string, storage string, tensor_column string, descriptor_relation string, descriptor_id string"
        return self.spark.createDataFrame([tuple(asdict(s).values()) for s in self.sources.values()], kinds)

    def resolve(self, name: str) -> Source:
        if name not in self.sources:
            raise KeyError(f"source {name} is not registered")
        self._validate(self.sources[name])
        return self.sources[name]

    def _columns(self, relation: str | None) -> dict[str, str]:
        if not relation or not self.spark.catalog.tableExists(relation):
            raise ValueError(f"relation {relation} does not exist")
        return dict(self.spark.table(relation).dtypes)

    def _validate(self, s: Source) -> None:
        if not s.model_contract:
            raise ValueError("model contract must not be empty")
        if s.storage not in STORAGES:
            raise ValueError(f"storage must be one of {', '.join(STORAGES)}")
        own = self._columns(s.relation)
        if own.get(s.public_id) not in ("int", "bigint"):
            raise ValueError("public id must be an int or bigint column")
        if own.get(s.contract_column) != "string":
            raise ValueError("contract column must be a string column")
        if s.storage == "heap_array":
            if not (own.get(s.tensor_column or "") or "").startswith("array<array<"):
                raise ValueError("tensor column must be an array of vectors")
            return
        table = own
        if s.storage == "external_relation":
            table = self._columns(s.descriptor_relation)
            if table.get(s.descriptor_id or "") != own[s.public_id]:
                raise ValueError("descriptor id must have the type of the public id")
        for c, kinds in _KINDS.items():
            if table.get(c) not in kinds:
                raise ValueError(f"{c} must be a {kinds[0]} column")

    def _under_contract(self, s: Source) -> DataFrame:
        return self.spark.table(s.relation).where(F.col(s.contract_column) == s.model_contract).where(F.col(s.public_id).isNotNull())

    def ids(self, name: str) -> DataFrame:
        """(id) of the documents under the contract."""
        s = self.resolve(name)
        return self._under_contract(s).select(F.col(s.public_id).cast("long").alias("id"))

    def described(self, name: str, required: bool) -> DataFrame:
        """(id, descriptor columns) under the contract; ``required``: a document without a descriptor fails, else it drops out."""
        s = self.resolve(name)
        if s.storage == "heap_array":
            raise ValueError("a heap_array source has no descriptors")
        own = self._under_contract(s)
        if s.storage == "external_ref":
            out = own.select(F.col(s.public_id).cast("long").alias("id"), *DESCRIPTOR)
        else:
            d = self.spark.table(s.descriptor_relation).select(F.col(s.descriptor_id).cast("long").alias("__d"), *DESCRIPTOR)
            ids = own.select(F.col(s.public_id).cast("long").alias("id"))
            out = ids.join(d, ids["id"] == d["__d"], "left" if required else "inner").drop("__d")
        out = out.withColumn("__bad", descriptor_problem())
        checked = F.when(F.col("__bad").isNull(), F.col("id")).otherwise(F.raise_error(F.concat_ws(": ", F.lit("bad tensor descriptor"), "__bad")).cast("long"))
        return out.withColumn("id", checked).drop("__bad")


def _scores(registry: Registry, store: TensorStore | None, name: str, ids: DataFrame, query, required: bool) -> DataFrame:
    """(id, distance) of the documents in ``ids`` under the contract; a heap_array source has no descriptors and skips null tensors."""
    q, s = checked_tensor(query), registry.resolve(name)
    if s.storage == "heap_array":
        held = registry._under_contract(s).select(F.col(s.public_id).cast("long").alias("id"), F.col(s.tensor_column).alias("tensor"))
        return exact_scores(held.join(ids, "id", "left_semi"), q, "id", "tensor")
    return external_scores(store.resolve(registry.described(name, required).join(ids, "id", "left_semi")), q)


def _most_similar(scored: DataFrame, k: int) -> DataFrame:
    return scored.select(F.col("id").alias("public_id"), (-F.col("distance")).alias("similarity")).orderBy(F.desc("similarity"), "public_id").limit(k)


def tensor_rerank(registry: Registry, store: TensorStore, name: str, query, candidate_ids: list[int], k: int) -> DataFrame:
    """(public_id, similarity): exact scores of given ids; ids without a descriptor drop out."""
    if not candidate_ids or any(i is None for i in candidate_ids) or len(set(candidate_ids)) < len(candidate_ids):
        raise ValueError("candidate ids must not be empty, NULL or repeated")
    if not 1 <= k <= len(candidate_ids):
        raise ValueError("top_k must be from 1 to the number of candidate ids")
    ids = registry.spark.createDataFrame([(int(i),) for i in candidate_ids], "id long")
    return _most_similar(_scores(registry, store, name, ids, query, required=False), k)


def registered_search(registry: Registry, store: TensorStore, name: str, docs: DataFrame, query, candidate_limit: int, k: int, id_col: str = "doc_id", tensor_col: str = "tokens") -> DataFrame:
    """(public_id, similarity): coarse candidates from ``docs``, exact external scores; a missing descriptor is an error.

    Only documents under the source's contract use up ``candidate_limit``.  A heap_array source is scored from its own tensors.
    """
    if not 1 <= candidate_limit <= MAX_CANDIDATES or not 1 <= k <= candidate_limit:
        raise ValueError("candidate_limit must be from 1 to 65536 and top_k from 1 to candidate_limit")
    found = coarse_candidates(docs, query, CoarseOptions(), id_col, tensor_col).join(registry.ids(name), "id", "left_semi")
    found = found.orderBy("estimate", "id").limit(candidate_limit)
    return _most_similar(_scores(registry, store, name, found.select("id"), query, required=True), k)
