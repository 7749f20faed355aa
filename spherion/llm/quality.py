"""Quality of documents: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded by counts of its bytes and words; a
hidden layer embeds it; gated attention, tanh(V h) * sigmoid(U h), weights the passages; a linear layer scores the
weighted sum.  Trained on the driver by Adam on a bounded sample of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spherion.llm.textkernel import blocks, texts_of, word_hashes, word_spans

#: Words of a passage; labelled documents, and evenly spaced passages of each, that training sees at most; the threshold of the contract.
PASSAGE, TRAINING_ROWS, TRAINING_PASSAGES, THRESHOLD = 64, 4000, 128, 0.3
HIDDEN, GATE, STEPS, RATE, DECAY = 16, 8, 800, 0.02, 1e-4

#: Byte classes whose shares are features: each punctuation mark, then digits, upper, lower, line ends, other white space, the rest.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.full(256, len(_MARKS) + 5, np.int32)
for _k, _b in enumerate(_MARKS):
    _CLASS[_b] = _k
for _k, _set in enumerate((b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b"\n\r", b" \t\x0b\x0c")):
    _CLASS[list(_set)] = len(_MARKS) + _k
N_CLASSES = len(_MARKS) + 6
N_FEATURES = N_CLASSES + 8


def passage_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, first): passages by row; text k has the rows first[k] to first[k + 1] - 1, at least one."""
    starts, ends, first_word = word_spans(raw, offsets)
    n_words = np.diff(first_word)
    bags = np.maximum(1, -(-n_words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(bags)])
    total = int(first[-1])
    out = np.zeros((total, N_FEATURES), np.float32)
    if not len(starts):
        return out, first
    text = np.repeat(np.arange(len(n_words)), n_words)
    passage = first[text] + (np.arange(len(starts)) - first_word[text]) // PASSAGE
    count = np.bincount(passage, minlength=total)
    one = np.maximum(count, 1)
    # Bytes belong to the passage of the last word that began before them.
    word_of_byte = np.zeros(len(raw), np.int32)
    word_of_byte[starts] = 1
    word_of_byte = np.maximum(np.cumsum(word_of_byte, dtype=np.int32) - 1, 0)
    shares = np.bincount(passage[word_of_byte] * N_CLASSES + _CLASS[raw], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    out[:, :N_CLASSES] = np.sqrt(shares / np.maximum(shares.sum(1, keepdims=True), 1))
    length = (ends - starts).astype(np.float64)
    hashes = word_hashes(raw, starts, ends)
    along = np.zeros(len(starts), bool)
    along[1:] = passage[1:] == passage[:-1]
    again = np.zeros(len(starts), bool)
    again[1:] = along[1:] & (hashes[1:] == hashes[:-1])
    order = np.lexsort((hashes, passage))
    new = np.ones(len(starts), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    head, tail = _CLASS[raw[starts]], _CLASS[raw[ends - 1]]
    mean = np.bincount(passage, length, total) / one
    columns = (
        mean / 10,
        np.sqrt(np.maximum(np.bincount(passage, length**2, total) / one - mean**2, 0)) / 10,
        np.bincount(passage, again, total) / one,
        np.bincount(passage[order], new, total) / one,
        np.bincount(passage, head == len(_MARKS) + 1, total) / one,
        np.bincount(passage, tail < len(_MARKS), total) / one,
        np.log1p(count) / 4,
        np.repeat(np.log1p(n_words) / 10, bags),
    )
    out[:, N_CLASSES:] = np.stack(columns, 1)
    return out, first


class AttentionModel:
    """score(features, first) -> a probability per bag."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        n = N_FEATURES
        self.mean, self.scale = np.zeros(n, np.float32), np.ones(n, np.float32)
        start = {"W": r.normal(0, n**-0.5, (n, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, GATE)), "U": r.normal(0, 0.3, (HIDDEN, GATE)), "w": r.normal(0, 0.3, GATE), "c": r.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
        self.p = {k: x.astype(np.float32) for k, x in start.items()}

    def _forward(self, x: np.ndarray, first: np.ndarray):
        p, at = self.p, first[:-1]
        bags = np.diff(first)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, at), bags))
        a /= np.repeat(np.add.reduceat(a, at), bags)
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return h, t, s, a, z, y

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward(self._standard(features), first)[-1]

    def fit(self, features: np.ndarray, first: np.ndarray, labels: np.ndarray) -> "AttentionModel":
        self.mean, self.scale = features.mean(0, dtype=np.float64).astype(np.float32), (features.std(0, dtype=np.float64) + 1e-3).astype(np.float32)
        x, bags, at = self._standard(features), np.diff(first), first[:-1]
        p, m, v = self.p, {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        # Both classes weigh the same up to a factor of four, so that a rare class is learnt.
        share = np.clip(labels.mean(), 0.1, 0.9)
        weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
        weight = (weight / weight.sum()).astype(np.float32)
        labels = labels.astype(np.float32)
        for step in range(1, STEPS + 1):
            h, t, s, a, z, y = self._forward(x, first)
            g = (y - labels) * weight
            gz = np.repeat(g[:, None] * p["c"], bags, axis=0)
            dot = (gz * h).sum(1)
            ge = a * (dot - np.repeat(np.add.reduceat(a * dot, at), bags))
            gt, gs = ge[:, None] * p["w"] * s * (1 - t**2), ge[:, None] * p["w"] * t * s * (1 - s)
            gh = (a[:, None] * gz + gt @ p["V"].T + gs @ p["U"].T) * (1 - h**2)
            grads = {"W": x.T @ gh, "b": gh.sum(0), "V": h.T @ gt, "U": h.T @ gs, "w": (ge[:, None] * t * s).sum(0), "c": z.T @ g, "d": np.array([g.sum()])}
            for k, q in grads.items():
                q = q + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees (a null id: not held out, yet never used for training either)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(doc_id, y): a bounded sample in hash order of what is not held out.  Repeated ids count once, by majority; nulls not at all."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("int").alias("y"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _feature_batches(batches):
    """Rows (id, y, x): evenly spaced passages of each text."""
    for batch in batches:
        raw, offsets = texts_of(batch.column(2))
        rows = []
        for a, b in blocks(offsets):
            x, first = passage_features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            rows += [x[s + np.arange(0, e - s, -(-(e - s) // TRAINING_PASSAGES))].tobytes() for s, e in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> AttentionModel | None:
    """A model from at most ``rows`` labelled documents; None where there are not both labels to learn from.

    Of documents with one id the one with the least features counts, so what reaches the driver is bounded.
    """
    known = training_labels(labels, "quality", rows).withColumnRenamed("doc_id", "__id")
    text = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.col("text").cast("string").alias("text"))
    seen = text.join(F.broadcast(known), text["__doc"] == known["__id"]).select("__id", "y", "text").mapInArrow(_feature_batches, "id long, y int, x binary")
    found = seen.groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("id").collect()
    y = np.array([r["y"] for r in found])
    if len(set(y.tolist())) < 2:
        return None
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in found]
    return AttentionModel().fit(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), y)


def _scores(model: AttentionModel | None, column: pa.Array) -> np.ndarray:
    raw, offsets = texts_of(column)
    if model is None:
        return np.ones(len(offsets) - 1)
    found = [model.score(*passage_features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in blocks(offsets)]
    return np.concatenate([np.zeros(0), *found]).astype(np.float64)


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row per row of ``docs``.

    Whole texts are scored; a null or empty text is one passage without words.  Null ids and repeated rows pass
    through; other columns are not read.  Without labels of both kinds every score is one.
    """
    model = train(docs, labels, rows)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the classifier accepts, scored and dropped in one pass: no shuffle, no join.

    Each row is judged by its own text, whatever its doc_id: null ids and repeated rows like any other, a null or empty
    text as one passage without words.  Other columns pass through; without labels of both kinds every row stays.
    """
    model, at = train(docs, labels), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(at)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
