"""What the operators of this subpackage share: scratch tables and partition counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: the space and U+0009 to U+000D, as a Java class.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spherion-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Paths of the tables that ``written`` made and ``release`` may delete.
_MADE: list[str] = []


def written(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared scratch folder and read it again."""
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.

    Only for what is ``written`` here: a DataFrame made here and collected twice elsewhere would miss its files.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def release(spark: SparkSession) -> int:
    """Deletes the scratch tables that this driver wrote so far; call it once results are stored.  Returns their number."""
    n = len(_MADE)
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def input_bytes(df: DataFrame, text: str) -> int:
    """Size of the files under ``df`` where it scans one relation; else the bytes of its texts, halved as files would."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    if leaves.size() == 1 and leaves.head().getClass().getSimpleName() == "LogicalRelation":
        return int(str(leaves.head().stats().sizeInBytes()))
    return (df.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0] or 0) // 2


#: Partitions at most; beyond, each grows with the input, and executors' memory must.
MOST_PARTITIONS = 100_000


def partitions_for(spark: SparkSession, size: int, each: int) -> int:
    """Partitions so that each holds about ``each`` of ``size`` input bytes; at least the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // each), MOST_PARTITIONS))


def partition_keys(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n partitions an integer that ``repartition(n, key)`` deals to it, so that n keys fill all partitions evenly."""
    tried = spark.range(30 * n + 100).select(F.col("id").cast("int").alias("key"))
    found = tried.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("p")).agg(F.min("key").alias("key")).toPandas()
    keys = np.arange(n, dtype=np.int32)
    keys[found["p"].to_numpy()] = found["key"].to_numpy()
    return keys


def same(left: Column, right: Column) -> Column:
    """Equality under which nulls are equal too."""
    return left.eqNullSafe(right)


#: Ids up to which they are sent to every executor (some 64 MB there); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def keep_rows(docs: DataFrame, key: str, kept: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in (``left_semi``) or not in (``left_anti``) ``kept``, whose only column is an id.

    The ids are written and counted first: few of them are sent to the texts, so texts move only for many.
    """
    other = written(docs.sparkSession, kept.toDF("__kept_id").distinct(), "ids")
    if other.count() <= BROADCAST_IDS:
        other = F.broadcast(other)
    return docs.join(other, same(docs[key], other["__kept_id"]), how)


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
