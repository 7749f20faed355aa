"""Toxicity of documents: a classifier chain.

The chain predicts ``low_quality``, then ``severe``, then ``toxic``.  ``labels`` marks quality and toxicity; severe is what
it marks as both toxic and of low quality, so every category is a label of its own and none a rule over the features.  Every
link is a logistic regression over the presence of indicative words and word beginnings and over how many words are
indicative of toxicity; links after the first also get the probabilities of the links before them.  In training these
are out of fold: indicative is what labelled documents hold significantly more often, and for each fold it is counted
anew without that fold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spherion.llm.quality import held_out
from spherion.llm.shared import written
from spherion.llm.textkernel import blocks, lowered, texts_of, word_hashes, word_spans

#: Labelled documents that training sees at most; features kept at most by label they indicate; their least z-score and documents.
TRAINING_ROWS, FEATURES, LEAST_Z, LEAST_DOCS = 8000, {"toxic": 192, "low": 48}, 5.0, 4
#: Bytes of the word beginnings that are features beside the whole word; numbers of indicative words that are features.
BEGINNINGS, COUNTS = (4, 5, 6), (1, 2, 3, 5)
CHAIN = ("low_quality", "severe", "toxic")
FOLDS, PENALTY, THRESHOLD = 5, 1e-3, 0.5

#: Bytes of words: letters, digits and all of UTF-8 beyond ASCII; punctuation separates.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(text, kinds): the text of each lower-cased word, and for each kind of feature the words that have it and its hashes."""
    raw = lowered(raw)
    starts, ends, first = word_spans(raw, offsets, _WORD)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    kinds = [(np.arange(len(starts)), word_hashes(raw, starts, ends))]
    for n in BEGINNINGS:
        own = np.flatnonzero(ends - starts > n)
        kinds.append((own, word_hashes(raw, starts[own], starts[own] + n) ^ np.uint64(n)))
    return text, kinds


def _feature_batches(batches):
    """Rows (fold, toxic, low, feature) of the distinct features of each text."""
    for batch in batches:
        raw, offsets = texts_of(batch.column(3))
        for a, b in blocks(offsets):
            text, kinds = word_features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            text, feature = np.concatenate([text[own] for own, _ in kinds]), np.concatenate([h for _, h in kinds])
            order = np.lexsort((feature, text))
            text, feature = text[order], feature[order]
            new = np.r_[True, (np.diff(text) != 0) | (feature[1:] != feature[:-1])][: len(text)]
            at = pa.array(text[new] + a)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(feature[new].view(np.int64))], ["fold", "toxic", "low", "feature"])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression with an L2 penalty, by Newton's method."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x1.shape[1]), np.full(x1.shape[1], PENALTY * len(x))
    ridge[-1] = 1e-6
    for _ in range(25):
        p = probability(x, w)
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(ridge), x1.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def categories(toxic: np.ndarray, low: np.ndarray) -> dict[str, np.ndarray]:
    return {"low_quality": low, "severe": toxic * low, "toxic": toxic}


class Evidence:
    """evidence(raw, offsets) -> a row per text: which features it has, and how many of its words indicate toxicity."""

    def __init__(self, toxic: np.ndarray, low: np.ndarray):
        self.features = np.union1d(toxic, low)
        self.counted = np.isin(self.features, toxic)
        self.width = len(self.features) + len(COUNTS)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.features & np.uint64(0xFFFF)] = True

    def rows(self, text: np.ndarray, kinds: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        known = len(self.features)
        x = np.zeros((n, self.width), np.uint8)
        indicative = np.zeros(len(text), bool)
        for own, feature in kinds if known else ():
            some = np.flatnonzero(self.maybe[feature & np.uint64(0xFFFF)])
            at = np.minimum(np.searchsorted(self.features, feature[some]), known - 1)
            hit = self.features[at] == feature[some]
            word, at = own[some[hit]], at[hit]
            x[text[word], at] = 1
            indicative[word[self.counted[at]]] = True
        hits = np.bincount(text[indicative], minlength=n)
        for k, least in enumerate(COUNTS):
            x[:, known + k] = hits >= least
        return x

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.rows(*word_features(raw, offsets), len(offsets) - 1)


class Chain:
    """probabilities(x) -> a column per category."""

    def __init__(self, evidence: Evidence):
        self.evidence, self.links = evidence, []

    def fit(self, x: np.ndarray, without: list[np.ndarray], labels: dict[str, np.ndarray], fold: np.ndarray) -> "Chain":
        """``without[k]``: features chosen without fold k, by which that fold's probabilities are found."""
        earlier = np.zeros((len(x), 0))
        for name in CHAIN:
            y, out = labels[name], np.zeros(len(x))
            for k in range(FOLDS):
                own, rest = fold == k, fold != k
                if own.any() and rest.any():
                    given = np.hstack([without[k], earlier])
                    out[own] = probability(given[own], logistic(given[rest], y[rest]))
            self.links.append(logistic(np.hstack([x, earlier]), y))
            earlier = np.hstack([earlier, out[:, None]])
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        given = x
        for w in self.links:
            given = np.hstack([given, probability(given, w)[:, None]])
        return given[:, x.shape[1] :]


def training_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(id, fold, toxic, low, text): a bounded sample in hash order of what is not held out, written once.

    Repeated ids count once: their labels by majority, of their texts the least.  A null quality isn't low.
    """
    quality = F.col("quality").cast("double") if "quality" in labels.columns else F.lit(None).cast("double")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        (F.avg(F.col("toxic").cast("double")) >= 0.5).cast("int").alias("toxic"), F.coalesce(F.avg(quality) < 0.5, F.lit(False)).cast("int").alias("low")
    )
    known = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    text = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = text.join(F.broadcast(known), text["__doc"] == known["id"]).groupBy("id", "toxic", "low").agg(F.min("text").alias("text"))
    fold = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)).cast("int")
    return written(docs.sparkSession, found.select("id", fold.alias("fold"), "toxic", "low", "text"), "sample")


def chosen_features(sample: DataFrame) -> list[Evidence]:
    """What indicates the labels: without each of the folds, and last over all of them, from one count by feature and fold."""
    folds = range(FOLDS + 1)

    def sums(value, name: str) -> list:
        return [F.sum(F.when(F.col("fold") != k, value).otherwise(F.lit(0))).cast("double").alias(f"{name}{k}") for k in folds]

    totals = sample.agg(*sums(F.lit(1), "n"), *sums(F.col("toxic"), "toxic"), *sums(F.col("low"), "low")).first()
    by = sample.select("fold", "toxic", "low", "text").mapInArrow(_feature_batches, "fold int, toxic int, low int, feature long")
    by = by.groupBy("feature").agg(*sums(F.lit(1), "n"), *sums(F.col("toxic"), "toxic"), *sums(F.col("low"), "low"))
    scores = []
    for label in FEATURES:
        for k in folds:
            share = (totals[f"{label}{k}"] or 0) / max(totals[f"n{k}"] or 0, 1)
            if 0 < share < 1:
                df, hits = F.col(f"n{k}"), F.col(f"{label}{k}")
                z = (hits - df * share) / F.sqrt(df * (share * (1 - share)))
                scores.append(F.struct(F.lit(label).alias("label"), F.lit(k).alias("k"), F.when(df >= LEAST_DOCS, z).alias("z")))
    if not scores:
        return [Evidence(np.zeros(0, np.uint64), np.zeros(0, np.uint64))] * (FOLDS + 1)
    ranked = by.select("feature", F.explode(F.array(*scores)).alias("s")).select("feature", "s.*").where(F.col("z") >= LEAST_Z)
    place = F.row_number().over(Window.partitionBy("label", "k").orderBy(F.desc("z"), "feature"))
    best = ranked.withColumn("place", place).where(F.col("place") <= max(FEATURES.values())).collect()

    def of(label: str, k: int) -> np.ndarray:
        return np.array([r["feature"] for r in best if r["label"] == label and r["k"] == k and r["place"] <= FEATURES[label]], np.int64).view(np.uint64)

    return [Evidence(of("toxic", k), of("low", k)) for k in folds]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Chain | None:
    """A chain from at most ``rows`` labelled documents; None where there are not both labels to learn from."""
    sample = training_sample(docs, labels, rows)
    facts = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    if facts["bad"] in (0, facts["n"]):
        return None
    evidence = chosen_features(sample)

    def run(batches):
        for batch in batches:
            raw, offsets = texts_of(batch.column(4))
            out = []
            for a, b in blocks(offsets):
                seen = word_features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out += [row.tobytes() for row in np.hstack([e.rows(*seen, b - a) for e in evidence])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(out, pa.binary())], ["id", "fold", "toxic", "low", "x"])

    seen = sample.mapInArrow(run, "id long, fold int, toxic int, low int, x binary").orderBy("id").toPandas()
    x = np.frombuffer(b"".join(seen["x"]), np.uint8).reshape(len(seen), -1)
    *without, whole = (p.astype(np.float64) for p in np.split(x, np.cumsum([e.width for e in evidence])[:-1], axis=1))
    labelled = categories(seen["toxic"].to_numpy(dtype=np.float64), seen["low"].to_numpy(dtype=np.float64))
    return Chain(evidence[-1]).fit(whole, without, labelled, seen["fold"].to_numpy())


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, low_quality, severe, toxic, predicted): probabilities per row of ``docs``; predicted is 1 where toxic >= 0.5.

    Whole texts are read; null and empty texts have no words.  Null ids and repeated rows pass through; other columns
    are not read.  Without labels of both kinds all probabilities are zero.
    """
    chain = train(docs, labels, rows)

    def run(batches):
        for batch in batches:
            raw, offsets = texts_of(batch.column(1))
            found = [np.zeros((0, len(CHAIN)))]
            for a, b in blocks(offsets):
                if chain is None:
                    found.append(np.zeros((b - a, len(CHAIN))))
                else:
                    found.append(chain.probabilities(chain.evidence(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))
            p = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(CHAIN)))], ["doc_id", *CHAIN])

    schema = "doc_id long, " + ", ".join(f"{c} double" for c in CHAIN)
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *CHAIN, (F.col("toxic") >= THRESHOLD).cast("int").alias("predicted"))
