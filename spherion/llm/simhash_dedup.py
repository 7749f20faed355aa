"""Near-duplicate documents: SimHash fingerprints, multi-index hashing, components.

A fingerprint has three segments of 22, 21 and 21 bits.  When two differ in at most four bits, either one of
the first two segments differs in at most one bit, or the third not at all.  So each fingerprint stands in three
tables under its segments, and looks up the ball of radius one around each of its first two.  Of two values that
differ in one bit exactly one has it set, so the ball is enumerated only by clearing set bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spherion.llm.components import connected_components
from spherion.llm.pairs import BOTH, PROBE, expand, forest, partner_ranges, spread_hot
from spherion.llm.shared import keep_rows, written

#: (first bit, bits, radius) of each table.
SEGMENTS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))
RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints of a bucket beyond which it is dealt over a grid of cells, and pairs compared at once.
HOT, BLOCK = 2000, 1 << 20

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of the shingles of the lower-cased (A-Z) words, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of ``hashes``, counted in byte lanes of 255 hashes at a time."""
    n = len(hashes)
    if not n:
        return 0
    at = np.arange(0, n, 255)
    out = 0
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, at)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n):
            out |= 1 << (8 * int(byte) + k)
    return out


def _fingerprint_batches(batches):
    for batch in batches:
        found = np.fromiter((majority(shingle_hashes(t.as_py() or "")) for t in batch.column(1)), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): a row per document; a null or empty text has fingerprint zero."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _table_rows(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        cells, roles, items = [], [], []
        for table, (shift, bits, radius) in enumerate(SEGMENTS):
            part = (fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
            cell = part.astype(np.int64) | (table << 32)
            cells.append(cell)
            roles.append(np.full(len(fp), BOTH, np.int32))
            items.append(fp)
            for bit in range(bits if radius else 0):
                on = np.flatnonzero((part >> np.uint64(bit)) & np.uint64(1))
                cells.append(cell[on] & ~np.int64(1 << bit))
                roles.append(np.full(len(on), PROBE, np.int32))
                items.append(fp[on])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(roles)), pa.array(np.concatenate(items).view(np.int64))], ["cell", "role", "fp"])


def _link_cells(batches):
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()) for b in batches]
    if not held:
        return
    cell, role, fp, salt = (np.concatenate(x) for x in zip(*held))
    order, lo, hi = partner_ranges(cell, salt, role)
    fp = fp[order].view(np.uint64)
    u, v, waiting = [], [], 0
    for i, j in expand(lo, hi, BLOCK):
        a, b = fp[i], fp[j]
        near = np.bitwise_count(a ^ b) <= RADIUS
        near &= a != b
        u.append(a[near].view(np.int64))
        v.append(b[near].view(np.int64))
        waiting += len(u[-1])
        if waiting > 4 * BLOCK:
            x, y = forest(np.concatenate(u), np.concatenate(v))
            u, v, waiting = [x], [y], len(x)
    if waiting:
        x, y = forest(np.concatenate(u), np.concatenate(v))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def fingerprint_links(spark: SparkSession, distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what differs in at most four bits; ``distinct`` has one column of distinct fingerprints.

    Pairs are compared inside their bucket and only a spanning forest of each task leaves it.
    """
    fp = distinct.toDF("fp")
    stands = F.explode(F.array(*[F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << b) - 1)).bitwiseOR(F.lit(t << 32)) for t, (s, b, _) in enumerate(SEGMENTS)]))
    hot = written(spark, fp.select(stands.alias("cell")).groupBy("cell").agg(F.count("*").alias("n_hot")).where(F.col("n_hot") > HOT), "hot")
    rows = fp.mapInArrow(_table_rows, "cell long, role int, fp long")
    rows = rows.withColumn("salt", F.lit(0)) if hot.isEmpty() else spread_hot(rows, hot, F.col("fp"), HOT)
    return rows.select("cell", "role", "fp", "salt").repartition("cell", "salt").mapInArrow(_link_cells, "a long, b long")


def simhash_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row per row of ``docs``.

    Null and empty texts and texts without words have fingerprint zero and link like any other.  Rows with a null
    doc_id get their component but never name one (null where a component has no id).  Equal rows stay equal rows;
    an empty table gives an empty table; other columns are not read.
    """
    found = written(spark, fingerprints(docs), "fingerprints")
    reps = written(spark, found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    linked = connected_components(spark, fingerprint_links(spark, reps.select("fp")))
    rooted = reps.join(linked.toDF("fp", "root"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return found.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id (rows with a null doc_id stay)."""
    gone = simhash_groups(spark, docs).where("doc_id <> component_id").select("doc_id")
    return keep_rows(docs, "doc_id", gone, "left_anti")
