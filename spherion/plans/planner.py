"""Settings of a search with their precedence, and the choice between a flat scan and an index."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spherion.operators import maxsim
from spherion.operators.ivf import IvfIndex, checked_probes
from spherion.operators.maxsim import BACKENDS, CoarseOptions
from spherion.operators.topk import top_k
from spherion.plans.cost import Corpus, cheapest


@dataclass(frozen=True)
class Settings:
    enable_scan: bool = True
    probes: str | None = None
    epsilon: float = 1.9
    max_scan_tuples: int = -1
    prefilter: bool = False
    ef_search: int = 64
    beam_search: int = 1
    maxsim_refine: int = 0
    maxsim_threshold: int = 0
    maxsim_candidate_limit: int = -1
    maxsim_backend: str = "coarse_only"
    planner_query_tokens: int = 32
    planner_document_tokens: int = 256

    def __post_init__(self):
        if not 0 <= self.epsilon <= 4 or self.max_scan_tuples < -1 or self.maxsim_refine < 0 or self.maxsim_threshold < 0 or self.maxsim_candidate_limit < -1:
            raise ValueError("setting out of range")
        if not 1 <= self.ef_search <= 65535 or not 1 <= self.beam_search <= 65535 or self.maxsim_backend not in BACKENDS:
            raise ValueError("setting out of range")

    def under(self, **session) -> "Settings":
        """Session values win over these (an index's own), which win over the defaults."""
        known = {f.name for f in fields(self)}
        if set(session) - known:
            raise ValueError(f"unknown setting: {', '.join(sorted(set(session) - known))}")
        return replace(self, **{k: v for k, v in session.items() if v is not None})


def scanned_rows(index: IvfIndex, rows: int, probes: str | None) -> float:
    """Rows and centroids that a search visits."""
    visited, share = 0.0, 1.0
    for (c, _), p in zip(index.levels, checked_probes(probes, len(index.levels))):
        visited += len(c) * share
        share = share * min(p / max(len(c) * share, 1e-9), 1.0)
    return visited + rows * share


def choose(index: IvfIndex | None, rows: int, settings: Settings, ordered: bool) -> str:
    """``index`` where one exists, is enabled, orders the result and visits fewer rows than a flat scan, else ``flat``."""
    if index is None or not settings.enable_scan or not ordered or (settings.probes is None and index.options.lists):
        return "flat"
    return "index" if scanned_rows(index, rows, settings.probes or "1") < rows else "flat"


def search(df: DataFrame, query, k: int, settings: Settings = Settings(), index: IvfIndex | None = None, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, distance) of the k nearest rows by the way that ``choose`` takes; the index must be over ``df``."""
    if index is not None and index.options.metric != metric:
        raise ValueError(f"the index orders by {index.options.metric}, not by {metric}")
    rows = 0 if index is None else df.count()
    if choose(index, rows, settings, query is not None) == "index":
        found = index.search(query, k, probes=settings.probes, epsilon=settings.epsilon, max_scan=settings.max_scan_tuples)
        return found.select(F.col(found.columns[0]).alias(id_col), "distance")
    return top_k(df, query, k, metric, id_col, vec_col, max_scan=settings.max_scan_tuples).select(id_col, "distance")


def maxsim_search(docs: DataFrame, query, k: int, settings: Settings = Settings(), index: IvfIndex | None = None, id_col: str = "doc_id", tensor_col: str = "tokens") -> tuple[str, DataFrame]:
    """(way, rows (id, distance)): late interaction by the way of least estimated seconds.

    Backend ``coarse_only`` never scores exactly, so it only chooses between its two ways.
    """
    options = CoarseOptions(settings.maxsim_refine, settings.maxsim_threshold, settings.maxsim_candidate_limit, settings.maxsim_backend).checked()
    size = docs.where(F.col(tensor_col).isNotNull()).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(tensor_col)), F.lit(0)).alias("t")).first()
    corpus = Corpus(size["n"], size["t"], len(query[0]))
    share = None
    if index is not None and settings.enable_scan and (settings.probes is not None or not index.options.lists):
        share = min(scanned_rows(index, int(size["t"]), settings.probes) / max(size["t"], 1), 1.0)
    if options.backend == "coarse_only":
        way = "coarse" if share is None else "indexed"
    else:
        way = cheapest(corpus, len(query), docs.sparkSession.sparkContext.defaultParallelism, options, share)
    if way == "exact":
        return way, maxsim.maxsim_top_k(docs, query, k, id_col=id_col, tensor_col=tensor_col)
    through = {"index": index, "probes": settings.probes or ""} if way == "indexed" else {}
    return way, maxsim.maxsim_search(docs, query, k, options, id_col, tensor_col, **through)
