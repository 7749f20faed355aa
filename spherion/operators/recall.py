"""Recall of approximate search, and the log of sampled queries."""

from __future__ import annotations

import json
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spherion.operators.ivf import IvfIndex


def recall(found: DataFrame, truth: DataFrame) -> float:
    """|found and truth| / |truth| of two one-column id sets; NaN where truth is empty."""
    total = truth.count()
    return found.toDF("id").intersect(truth.toDF("id")).count() / total if total else float("nan")


def query_recall(index: IvfIndex, query, k: int, probes: str, exact: DataFrame | None = None, accu_probes: str | None = None, accu_epsilon: float = 1.9) -> float:
    """Recall of one query at ``probes`` against ``exact`` ids, or against a search at ``accu_probes`` (default 65535 a level)."""
    if accu_probes is None:
        accu_probes = ",".join(["65535"] * len([p for p in probes.split(",") if p.strip()]))
    truth = exact if exact is not None else index.search(query, k, accu_probes or None, accu_epsilon).select("id")
    return recall(index.search(query, k, probes or None).select("id"), truth)


class QuerySampler:
    """Keeps at most ``max_records`` sampled queries per index in a folder of JSON rows; rate 0 keeps none."""

    def __init__(self, spark: SparkSession, path: str, rate: float = 0.0, max_records: int = 0, enabled: bool = True, seed: int | None = None):
        if not 0 <= rate <= 1 or not 0 <= max_records <= 10000:
            raise ValueError("option out of range")
        self.spark, self.path, self.rate, self.max_records, self.enabled = spark, path, rate, max_records, enabled
        self.random = np.random.default_rng(seed)

    def record(self, index: str, query, metric: str = "l2", vec_col: str = "embedding") -> bool:
        if not self.enabled or not self.max_records or self.random.random() >= self.rate:
            return False
        row = (index, time.time_ns(), metric, vec_col, json.dumps([float(x) for x in query]), uuid.uuid4().hex)
        self.spark.createDataFrame([row], "index string, at long, metric string, vec_col string, value string, key string").coalesce(1).write.mode("append").json(self.path)
        return True

    def _all(self) -> DataFrame:
        log = self.spark.read.schema("index string, at long, metric string, vec_col string, value string, key string").json(self.path)
        from pyspark.sql import Window

        newest = F.row_number().over(Window.partitionBy("index").orderBy(F.desc("at"), "key"))
        return log.withColumn("r", newest).where(F.col("r") <= self.max_records)

    def sampled_values(self, index: str) -> DataFrame:
        return self._all().where(F.col("index") == index).select("value")

    def sampled_queries(self, index: str | None = None) -> DataFrame:
        """(index, metric, vec_col, value) of one index or of all."""
        rows = self._all()
        return (rows if index is None else rows.where(F.col("index") == index)).select("index", "metric", "vec_col", "value")

    def drop(self, index: str, path: str) -> None:
        """Copies the log to ``path`` without an index, and goes on there."""
        self.spark.read.schema("index string, at long, metric string, vec_col string, value string, key string").json(self.path).where(F.col("index") != index).write.mode("overwrite").json(path)
        self.path = path
