"""Half-precision and quantized columns: conversion, distances, range predicates and MaxSim on codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spherion.functions import rabitq
from spherion.functions.kernels import half, matrix

SCHEMA = "struct<dim:int,sum_of_x2:float,norm_of_lattice:float,sum_of_code:float,sum_of_abs_x:float,code:binary>"
_TYPE = pa.struct([("dim", pa.int32()), *((f, pa.float32()) for f in rabitq.FIELDS), ("code", pa.binary())])


def _structs(x: np.ndarray, bits: int) -> list[dict]:
    code, factors = rabitq.quantize(x, bits)
    packed = rabitq.pack(code, bits)
    return [{"dim": x.shape[1], **{f: float(np.float32(factors[f][k])) for f in rabitq.FIELDS}, "code": packed[k].tobytes()} for k in range(len(x))]


def _codes(rows: list[dict], bits: int) -> tuple[np.ndarray, dict]:
    dims = {r["dim"] for r in rows}
    if len(dims) > 1:
        raise ValueError("dimension is not matched")
    packed = np.frombuffer(b"".join(r["code"] for r in rows), np.uint8).reshape(len(rows), -1)
    return rabitq.unpack(packed, bits, dims.pop()), {f: np.array([r[f] for r in rows], np.float64) for f in rabitq.FIELDS}


def quantize(column: Column | str, bits: int = 8) -> Column:
    """array<float> -> code struct; null stays null.  ``bits`` is 8 or 4."""

    @F.arrow_udf(SCHEMA)
    def run(v: pa.Array) -> pa.Array:
        rows, x = matrix(v)
        out = [None] * len(v)
        for k, s in zip(rows, _structs(x, bits) if len(x) else []):
            out[k] = s
        return pa.array(out, _TYPE)

    return run(column)


def dequantize(column: Column | str, bits: int = 8, to_half: bool = False) -> Column:
    """code struct -> array<float>, optionally rounded to half precision."""

    @F.arrow_udf("array<float>")
    def run(v: pa.Array) -> pa.Array:
        rows = v.to_pylist()
        at = [k for k, r in enumerate(rows) if r is not None]
        out = [None] * len(rows)
        if at:
            x = rabitq.dequantize(*_codes([rows[k] for k in at], bits), bits)
            for k, row in zip(at, half(x) if to_half else x):
                out[k] = row.astype(np.float32)
        return pa.array(out, pa.list_(pa.float32()))

    return run(column)


def to_half(column: Column | str) -> Column:
    """array<float> whose values are rounded to half precision."""

    @F.arrow_udf("array<float>")
    def run(v: pa.Array) -> pa.Array:
        flat = v.flatten().to_numpy(zero_copy_only=False).astype("<f2").astype(np.float32)
        sizes = v.value_lengths().fill_null(0).to_numpy()
        values = iter(np.split(flat, np.cumsum(sizes)[:-1]))
        return pa.array([x if ok else None for x, ok in zip(values, v.is_valid().to_pylist())], pa.list_(pa.float32()))

    return run(column)


def code_distance(metric: str, a: Column | str, b: Column | str, bits: int = 8) -> Column:
    """``l2``, ``ip`` or ``cosine`` (minus the cosine, as the operator on codes gives it); null for null."""

    @F.arrow_udf("double")
    def run(v: pa.Array, w: pa.Array) -> pa.Array:
        x, y = v.to_pylist(), w.to_pylist()
        at = [k for k in range(len(x)) if x[k] is not None and y[k] is not None]
        out = [None] * len(x)
        if at:
            cx, cy = _codes([x[k] for k in at], bits), _codes([y[k] for k in at], bits)
            if cx[0].shape != cy[0].shape:
                raise ValueError("dimension is not matched")
            for k, d in zip(at, rabitq.code_distance(metric, bits, cx, cy).tolist()):
                out[k] = d
        return pa.array(out, pa.float64())

    return run(a, b)


def code_within(metric: str, a: Column | str, center: Column | str, radius: float, bits: int = 8) -> Column:
    return code_distance(metric, a, center, bits) < F.lit(float(radius))


def code_maxsim(document: Column | str, query: Column | str, bits: int = 8) -> Column:
    """MaxSim over arrays of code structs; the right operand is the query."""

    @F.arrow_udf("double")
    def run(v: pa.Array, w: pa.Array) -> pa.Array:
        out = []
        for d, q in zip(v.to_pylist(), w.to_pylist()):
            if d is None or q is None:
                out.append(None)
                continue
            if not d or not q or None in d or None in q:
                raise ValueError("multi-vector must not be empty or contain NULL")
            (cd, fd), (cq, fq) = _codes(d, bits), _codes(q, bits)
            if cd.shape[1] != cq.shape[1]:
                raise ValueError("dimension is not matched")
            i, j = (x.ravel() for x in np.meshgrid(np.arange(len(q)), np.arange(len(d)), indexing="ij"))
            pair = rabitq.code_distance("ip", bits, (cd[j], {f: x[j] for f, x in fd.items()}), (cq[i], {f: x[i] for f, x in fq.items()}))
            out.append(float(pair.reshape(len(q), len(d)).min(1).sum()))
        return pa.array(out, pa.float64())

    return run(document, query)


def format_codes(column: Column | str, bits: int = 8) -> Column:
    """The text form of code structs."""

    @F.pandas_udf("string")
    def run(v: pd.DataFrame) -> pd.Series:
        return pd.Series([rabitq.format_code(r, rabitq.unpack(np.frombuffer(r["code"], np.uint8)[None], bits, int(r["dim"]))[0]) if r["code"] is not None else None for r in v.to_dict("records")])

    return run(column)


def quantized_top_k(df: DataFrame, query, k: int, metric: str = "l2", bits: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, distance): both sides quantized, distances on codes."""
    q_code = rabitq.quantize(np.asarray([query], np.float64), bits)

    def run(batches):
        for batch in batches:
            rows, x = matrix(batch.column(1))
            if len(x):
                c, f = rabitq.quantize(x, bits)
                other = (np.repeat(q_code[0], len(x), 0), {n: np.repeat(v, len(x)) for n, v in q_code[1].items()})
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(rabitq.code_distance(metric, bits, (c, f), other))], ["id", "distance"])

    scored = df.select(F.col(id_col).cast("long").alias("id"), vec_col).mapInArrow(run, "id long, distance double")
    return scored.orderBy("distance", "id").limit(k)
