"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

A rotation learnt on a bounded sample turns each vector into a balanced 64-bit code.  Codes stand in four tables of 16
bits; each looks up the ball of radius one around every 16 bits, so pairs within seven bits always meet (of two values
that differ in one bit exactly one has it set, so only set bits are cleared).  Every pair that a table finds counts.
A code travels with a sketch: the vector's coordinates along ``AXES`` orthonormal axes and the length of what they leave.
The product of two sketches is never below the cosine (Cauchy-Schwarz), so vectors without a partner whose sketch
reaches the threshold have no link here; only the others are dealt again, with their components, and compared by cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spherion.llm.components import connected_components
from spherion.llm.pairs import BOTH, PROBE, expand, forest, partner_ranges, spread_hot
from spherion.llm.shared import written

THRESHOLD = 0.95
BITS, TABLES, AXES = 64, 4, 16
#: Vectors that the rotation is learnt from at most, and rounds of learning.
SAMPLE, ROUNDS = 4096, 50
#: Sketches are halves of length one: rounding moves a product by less than 2 * 2^-11 + 2^-22.
SLACK = 0.002
#: Codes of a bucket beyond which it is dealt over a grid of cells; pairs compared at once by sketch and by vector.
HOT, SKETCH_BLOCK, VECTOR_BLOCK = 500, 1 << 17, 1 << 15

_PART = BITS // TABLES
_MASK = np.uint64((1 << _PART) - 1)


def unit_vectors(rows: list[list | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(valid, units): which rows can link, and those as double vectors of length one."""
    valid, units = np.zeros(len(rows), bool), []
    for k, row in enumerate(rows):
        if row is not None and len(row) and None not in row:
            x = np.array(row, np.float64)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                x = x / top
                units.append(x / np.sqrt(x @ x))
                valid[k] = True
    return valid, units


def sketch_axes(sample: np.ndarray, dim: int) -> np.ndarray:
    """Up to AXES orthonormal columns that hold most of the sample's length (not of its spread: the mean counts)."""
    lead = np.linalg.svd(sample, full_matrices=False)[2][:AXES].T if len(sample) else np.zeros((dim, 0))
    fill = np.random.default_rng([13, dim]).normal(size=(dim, max(min(AXES, dim) - lead.shape[1], 0)))
    return np.linalg.qr(np.hstack([lead, fill]))[0]


def sketches(units: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """A row of AXES + 1 halves per unit vector; the product of two rows plus SLACK is at least the vectors' cosine."""
    along = units @ axes
    rest = np.linalg.norm(units - along @ axes.T, axis=1)
    out = np.zeros((len(units), AXES + 1), np.float16)
    out[:, : along.shape[1]], out[:, AXES] = along, rest
    return out


def learn(sample: np.ndarray, dim: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, projection to BITS, axes of the sketch): principal axes, rotated to lose least when signs are taken.

    Fewer than BITS dimensions or sample rows leave some directions; random ones fill up.
    """
    r = np.random.default_rng([seed, dim])
    if len(sample) < 2:
        return np.zeros(dim), r.normal(size=(dim, BITS)), sketch_axes(sample, dim)
    mean = sample.mean(0)
    x = sample - mean
    axes = np.linalg.svd(x, full_matrices=False)[2][: min(BITS, dim, len(sample))].T
    v = x @ axes
    rotation = np.linalg.qr(r.normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(ROUNDS):
        code = np.where(v @ rotation >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(code.T @ v)
        rotation = (u @ w).T
    projection = axes @ rotation
    return mean, np.hstack([projection, r.normal(size=(dim, BITS - projection.shape[1]))]), sketch_axes(sample, dim)


def codes(units: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    bits = (units - model[0]) @ model[1] >= 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def _code_batches(models: dict):
    def run(batches):
        for batch in batches:
            valid, units = unit_vectors(batch.column(1).to_pylist())
            dim, code = np.zeros(len(valid), np.int32), np.zeros(len(valid), np.uint64)
            sketch, data = [None] * len(valid), [None] * len(valid)
            at = np.flatnonzero(valid)
            dim[at] = [len(u) for u in units]
            for d in np.unique(dim[at]).tolist():
                own = np.flatnonzero(dim == d)
                x = np.stack([u for u in units if len(u) == d])
                model = models.get(d) or learn(x[:0], d)
                code[own] = codes(x, model)
                for k, u, s in zip(own, x, sketches(x, model[2])):
                    data[k], sketch[k] = u.tobytes(), s.tobytes()
            columns = [batch.column(0), pa.array(dim), pa.array(code.view(np.int64)), pa.array(sketch, pa.binary()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dim", "code", "sketch", "unit"])

    return run


def _table_batches(batches):
    """Rows (cell, role, rep, code, sketch): where each code stands and looks.  A cell names dimension, table and 16 bits."""
    for batch in batches:
        rep, code, every = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64), np.arange(batch.num_rows)
        room = batch.column(1).to_numpy().astype(np.int64) * TABLES << _PART
        out = []
        for t in range(TABLES):
            part = (code >> np.uint64(t * _PART)) & _MASK
            cell = room + (t << _PART) + part.astype(np.int64)
            out.append((cell, np.full(len(rep), BOTH, np.int32), every))
            for bit in range(_PART):
                on = np.flatnonzero((part >> np.uint64(bit)) & np.uint64(1))
                out.append((cell[on] - (1 << bit), np.full(len(on), PROBE, np.int32), on))
        cell, role, of = (np.concatenate(x) for x in zip(*out))
        columns = [pa.array(cell), pa.array(role), pa.array(rep[of]), pa.array(code[of].view(np.int64)), batch.column(3).take(pa.array(of))]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "role", "rep", "code", "sketch"])


def _meets_here(cell: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``cell`` lies in the first table whose 16 bits differ in at most one: there a pair meets once."""
    table = (cell >> _PART) % TABLES
    x, here = a ^ b, np.ones(len(a), bool)
    for t in range(TABLES - 1):
        near = np.bitwise_count((x >> np.uint64(t * _PART)) & _MASK) <= 1
        here &= ~near | (table <= t)
    return here


def _cell_pairs(cell, salt, role, code, block):
    order, lo, hi = partner_ranges(cell, salt, role)
    cell, code = cell[order], code[order]
    for i, j in expand(lo, hi, block):
        here = _meets_here(cell[i], code[i], code[j])
        yield order[i[here]], order[j[here]]


def _partner_batches(batches):
    """The rows that have a partner in their cell whose sketch allows a link."""
    held = [([c.to_numpy() for c in b.columns[:5]], np.frombuffer(b"".join(b.column(5).to_pylist()), np.float16)) for b in batches]
    if held:
        cell, salt, role, rep, code = (np.concatenate(x) for x in zip(*[h[0] for h in held]))
        sketch = np.concatenate([h[1] for h in held]).reshape(len(cell), -1)
        wanted = np.zeros(len(cell), bool)
        for i, j in _cell_pairs(cell, salt, role, code.view(np.uint64), SKETCH_BLOCK):
            bound = np.einsum("ij,ij->i", sketch[i].astype(np.float32), sketch[j].astype(np.float32))
            may = (bound >= THRESHOLD - SLACK) & (rep[i] != rep[j])
            wanted[i[may]] = wanted[j[may]] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[wanted]) for x in (cell, salt, role, rep, code)], ["cell", "salt", "role", "rep", "code"])


def _link_batches(batches):
    """Rows (a, b, n): with b null, n more vectors link with a; else an edge that keeps a and b connected."""
    held = [([c.to_numpy() for c in b.columns[:6]], b.column(6).to_pylist()) for b in batches]
    if not held:
        return
    cell, salt, role, rep, code, weight = (np.concatenate(x) for x in zip(*[h[0] for h in held]))
    units = [np.frombuffer(u, np.float64) for h in held for u in h[1]]
    pad = max(map(len, units))  # a cell has one dimension, so padding never mixes
    x = np.stack([u if len(u) == pad else np.pad(u, (0, pad - len(u))) for u in units])
    names, own = np.unique(rep, return_inverse=True)
    links, u, v, waiting = np.zeros(len(names), np.int64), [], [], 0
    for i, j in _cell_pairs(cell, salt, role, code.view(np.uint64), VECTOR_BLOCK):
        near = (np.einsum("ij,ij->i", x[i], x[j]) >= THRESHOLD) & (rep[i] != rep[j])
        i, j = i[near], j[near]
        if (role[i] == BOTH).all():
            seen = np.ones(len(i), bool)
        else:  # in a grid of cells two values that are equal meet from either side; count one of them
            equal = ((code[i] ^ code[j]).view(np.uint64) >> (((cell[i] >> _PART) % TABLES) * _PART).astype(np.uint64)) & _MASK == 0
            seen = ~(equal & (role[i] == PROBE) & (rep[i] > rep[j]))
        i, j = i[seen], j[seen]
        np.add.at(links, own[i], weight[j])
        np.add.at(links, own[j], weight[i])
        u.append(own[i])
        v.append(own[j])
        waiting += len(i)
        if waiting > 1 << 20:
            a, b = forest(np.concatenate(u), np.concatenate(v))
            u, v, waiting = [a], [b], len(a)
    some = np.flatnonzero(links)
    yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.nulls(len(some), pa.int64()), pa.array(links[some])], ["a", "b", "n"])
    if waiting:
        a, b = forest(np.concatenate(u), np.concatenate(v))
        yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b]), pa.nulls(len(a), pa.int64())], ["a", "b", "n"])


def learnt_models(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A model for each dimension in a sample of at most SAMPLE vectors, in hash order."""
    sample = vectors.select("embedding").where("embedding is not null and vec_id is not null").orderBy(F.xxhash64(vectors["vec_id"])).limit(SAMPLE)
    _, units = unit_vectors([r[0] for r in sample.collect()])
    return {d: learn(np.stack([u for u in units if len(u) == d]), d) for d in sorted({len(u) for u in units})}


def near_duplicate_vectors(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row per row of ``embeddings`` (vec_id, embedding).

    Vectors link where their cosine in double precision is at least 0.95 and the tables find the pair (recall is tested
    against brute force); vectors of different lengths never do.  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; rows with a null vec_id neither.  Equal vectors are compared once and
    counted each; repeated rows count each; other columns, labels among them, are not read.
    """
    given = embeddings.select(F.col("vec_id").cast("long"), "embedding")
    coded = written(spark, given.mapInArrow(_code_batches(learnt_models(given)), "vec_id long, dim int, code long, sketch binary, unit binary"), "codes")
    able = coded.where("unit is not null and vec_id is not null")
    same = [F.first(c).alias(c) for c in ("dim", "code", "sketch")]
    reps = written(spark, able.groupBy("unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), *same), "vectors")

    rows = reps.select("rep", "dim", "code", "sketch").mapInArrow(_table_batches, "cell long, role int, rep long, code long, sketch binary")
    hot = written(spark, rows.groupBy("cell").agg(F.count("*").alias("n_hot")).where(F.col("n_hot") > HOT), "hot")
    rows = rows.withColumn("salt", F.lit(0)) if hot.isEmpty() else spread_hot(rows, hot, F.col("rep"), HOT)
    rows = rows.select("cell", "salt", "role", "rep", "code", "sketch").repartition("cell", "salt")
    partnered = rows.mapInArrow(_partner_batches, "cell long, salt int, role int, rep long, code long")
    dressed = partnered.join(reps.select("rep", "weight", "unit"), "rep").select("cell", "salt", "role", "rep", "code", "weight", "unit")
    links = written(spark, dressed.repartition("cell", "salt").mapInArrow(_link_batches, "a long, b long, n long"), "links")

    counts = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    linked = connected_components(spark, links.where("b is not null").select("a", "b")).toDF("rep", "component")
    classes = reps.join(counts, "rep", "left").join(linked, "rep", "left")
    classes = classes.select("unit", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    own = F.when(F.col("vec_id").isNotNull(), F.col("unit"))
    found = coded.select("vec_id", own.alias("own")).join(classes, F.col("own") == classes["unit"], "left")
    component = F.coalesce("component", "vec_id")
    return found.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
