"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spherion.llm.bpe import default_vocabulary, encode_documents
from spherion.llm.chat_format import ORACLE, PLANTED, conversation_digests, format_conversations
from spherion.llm.decontaminate import find_leaks
from spherion.llm.itq_dedup import near_duplicate_vectors
from spherion.llm.quality import score_quality
from spherion.llm.secrets import find_secrets
from spherion.llm.simhash_dedup import simhash_groups
from spherion.llm.substring_dedup import remove_repeats
from spherion.llm.toxicity import score_toxicity
from spherion.llm.url_filter import filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark, _table(spark, sf_dir, "embeddings"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark, _table(spark, sf_dir, "pages"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(PLANTED))
    return conversation_digests(format_conversations(turns))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, _table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(_table(spark, sf_dir, "documents"), default_vocabulary())
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark, _table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": ORACLE}
