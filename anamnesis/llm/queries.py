"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm import bpe, centroids, chat_format, embedding_dedup, exact_dedup, licenses, line_dedup, main_text, merkle, mixing, near_dedup, pii, toxicity
from anamnesis.llm.base import table


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_values(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_report(table(spark, sf_dir, "documents"), words=2)


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op7_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_report(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(table(spark, sf_dir, "pages"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_report(chat_format.with_conflict(spark, table(spark, sf_dir, "conversations")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudonyms": op1_pseudonyms,
    "op2_mix_sources": op2_mix_sources,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_near_dedup": op5_near_dedup,
    "op6_line_runs": op6_line_runs,
    "op7_bpe_tokens": op7_bpe_tokens,
    "op8_licenses": op8_licenses,
    "op9_main_text": op9_main_text,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_centroids": op11_centroids,
    "op12_chat_format": op12_chat_format,
    "op13_merkle": op13_merkle,
}

SQL: dict[str, str] = {
    "op2_mix_sources": mixing.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op6_line_runs": line_dedup.SQL,
    "op11_centroids": centroids.SQL,
    "op12_chat_format": chat_format.SQL,
    "op13_merkle": merkle.SQL,
}
