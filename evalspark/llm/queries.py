"""Thin queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, crosspolytope, decontaminate, dualtree, minhash, mixing, pieces, quality, ranked, secretscan, substring, toxicity
from .sharding import shard


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secret_report(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_crosspolytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_dualtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.mine(_table(spark, sf_dir, "embeddings"), label=dualtree.shifted_label())


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_sharding, op3_mixing, op4_toxicity, op5_neighbours, op6_minhash, op7_secrets, op8_quality, op9_substring, op10_crosspolytope, op11_ranked, op12_dualtree, op13_decontaminate)
}
ORACLES: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op6_minhash": minhash.ORACLE,
    "op7_secrets": secretscan.ORACLE,
    "op9_substring": substring.ORACLE,
    "op10_crosspolytope": crosspolytope.ORACLE,
    "op11_ranked": ranked.ORACLE,
    "op12_dualtree": dualtree.ORACLE,
    "op13_decontaminate": decontaminate.ORACLE,
}
