"""The contract queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, jaccard_join, license_scan, order_minhash, quality, secrets, sharding, sort_means, toxicity, trie_bpe, whitening
from .common import held_out, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: Centroids, rounds, width, scale and seed of the clustering.
CLUSTERING = {"k": 40, "rounds": 5, "dim": 64, "scale": 256, "seed": 2}


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), "doc_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "strength")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_probe(table(spark, sf_dir, "conversations")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.leak_report(found)


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.report(*sort_means.cluster(table(spark, sf_dir, "embeddings"), **CLUSTERING))


def op12_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.round_trip_digest(table(spark, sf_dir, "documents"), WORDS)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), dim=64, scale=64, shift=1_000_000, most=16)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every contract query by name, in the order of the operators."""
    own = (op1_sharding, op2_license_scan, op3_quality, op4_chat_format, op5_toxicity, op6_fingerprint, op7_bpe, op8_secrets, op9_jaccard_join, op10_decontamination, op11_sort_means, op12_trie_bpe, op13_whitening)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.oracle_sql(), "op4_chat_format": chat.ORACLE_SQL, "op8_secrets": secrets.oracle_sql(), "op11_sort_means": sort_means.oracle_sql(**CLUSTERING)}
