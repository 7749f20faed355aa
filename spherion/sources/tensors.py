"""Content-addressed tensors as a table, their descriptors, and verified resolution."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spherion.functions.kernels import maxsim

#: Fixed limits of descriptors.
MAX_ROWS, MAX_DIM, MAX_REF = 65536, 60000, 4096
DTYPES = {"float16": "<f2", "float32": "<f4"}
_CHECKSUM, _CONTROL = r"\Asha256:[0-9a-f]{64}\z", r"[\x00-\x1f\x7f]"


def descriptor_problem(ref: str = "tensor_ref", rows: str = "tensor_rows", dim: str = "tensor_dim", dtype: str = "tensor_dtype", checksum: str = "tensor_checksum") -> Column:
    """What is wrong with the tensor descriptor in these columns, or null; nulls are wrong."""
    rules = [
        ("tensor_ref is invalid", (F.col(ref) != "") & (F.octet_length(ref) <= MAX_REF) & ~F.col(ref).rlike(_CONTROL)),
        (f"tensor_rows must be from 1 to {MAX_ROWS}", F.col(rows).between(1, MAX_ROWS)),
        (f"tensor_dim must be from 1 to {MAX_DIM}", F.col(dim).between(1, MAX_DIM)),
        (f"tensor_dtype must be {' or '.join(DTYPES)}", F.col(dtype).isin(*DTYPES)),
        ("tensor_checksum must be sha256: and 64 lower-case hexadecimal digits", F.col(checksum).rlike(_CHECKSUM)),
    ]
    return F.coalesce(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(text)) for text, holds in rules])


def descriptors(docs: DataFrame, id_col: str = "doc_id", tensor_col: str = "tokens", dtype: str = "float16") -> DataFrame:
    """(id, tensor_ref, tensor_rows, tensor_dim, tensor_dtype, tensor_checksum, payload) of array<array<float>> tensors."""
    kind = DTYPES[dtype]

    def run(batches):
        for batch in batches:
            out = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t is not None:
                    x = np.asarray(t, np.float32).astype(kind)
                    digest = hashlib.sha256(x.tobytes()).hexdigest()
                    out.append((key, f"sha256://{digest}", x.shape[0], x.shape[1], dtype, f"sha256:{digest}", x.tobytes()))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary())
            names = ["id", "tensor_ref", "tensor_rows", "tensor_dim", "tensor_dtype", "tensor_checksum", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(7)], names)

    schema = "id long, tensor_ref string, tensor_rows int, tensor_dim int, tensor_dtype string, tensor_checksum string, payload binary"
    return docs.select(F.col(id_col).cast("long"), tensor_col).mapInArrow(run, schema)


class TensorStore:
    """A Parquet table (digest, rows, dim, dtype, payload); equal contents are stored once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        return self.spark.read.schema("digest string, rows int, dim int, dtype string, payload binary").parquet(self.path)

    def publish(self, described: DataFrame) -> None:
        """Adds what is not there yet, so publishing again changes nothing."""
        new = described.select(F.substring("tensor_checksum", 8, 64).alias("digest"), F.col("tensor_rows").alias("rows"), F.col("tensor_dim").alias("dim"), F.col("tensor_dtype").alias("dtype"), "payload").dropDuplicates(["digest"])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(self._rows().select("digest"), "digest", "left_anti").select("digest", "rows", "dim", "dtype", "payload")
        new.write.mode("append").parquet(self.path)

    def collect_garbage(self, live: DataFrame, path: str) -> "TensorStore":
        """A copy with only the tensors that ``live`` (tensor_checksum) names."""
        kept = live.select(F.substring("tensor_checksum", 8, 64).alias("digest")).distinct()
        self._rows().join(kept, "digest", "left_semi").write.mode("overwrite").parquet(path)
        return TensorStore(self.spark, path)

    def resolve(self, described: DataFrame, required: bool = True) -> DataFrame:
        """``described`` with ``payload``; length and sha-256 are verified, missing tensors fail if ``required``, else drop out."""
        store = self._rows().select("digest", F.col("payload").alias("__data"))
        given = described.drop("payload").withColumn("digest", F.substring("tensor_checksum", 8, 64))
        out = given.join(store, "digest", "left" if required else "inner")
        width = F.when(F.col("tensor_dtype") == "float16", 2).otherwise(4)
        sound = (F.length("__data") == F.col("tensor_rows").cast("long") * F.col("tensor_dim") * width) & (F.sha2("__data", 256) == F.col("digest"))
        checked = F.when(sound, F.col("__data")).otherwise(F.raise_error(F.concat(F.lit("tensor is missing or damaged: "), F.col("digest"))).cast("binary"))
        return out.withColumn("payload", checked).drop("__data", "digest")


def external_scores(resolved: DataFrame, query: np.ndarray) -> DataFrame:
    """(id, distance): MaxSim of resolved tensors; equal contents are scored once and fanned out; non-finite values fail."""
    q = np.asarray(query, np.float64)

    def run(batches):
        for batch in batches:
            keys, scores = [], []
            for key, dim, dtype, payload in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(payload, DTYPES[dtype]).astype(np.float64).reshape(-1, dim)
                if not np.isfinite(x).all():
                    raise ValueError("tensor has a non-finite value")
                if dim != q.shape[1]:
                    raise ValueError("dimension is not matched")
                keys.append(key)
                scores.append(maxsim(x, q))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(scores, pa.float64())], ["tensor_checksum", "distance"])

    unique = resolved.select("tensor_checksum", "tensor_dim", "tensor_dtype", "payload").dropDuplicates(["tensor_checksum"])
    scored = unique.mapInArrow(run, "tensor_checksum string, distance double")
    return resolved.select("id", "tensor_checksum").join(scored, "tensor_checksum").select("id", "distance")
