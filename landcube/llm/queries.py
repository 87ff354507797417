"""The corpus queries that ``__spark_entry__`` registers: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landcube.llm import alignment, covertree, decontamination, divergence, html, linededup, lm, mixing, packing, sharding, simhash, suffix, toxicity
from landcube.llm.common import table


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.report(table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_top_k, op2_simhash, op3_suffix_dedup, op4_sharding, op5_decontamination, op6_best_fit_packing, op7_toxicity, op8_line_dedup, op9_html_extraction, op10_language_model, op11_mixing, op12_alignment, op13_divergence)
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": covertree.ORACLE_SQL,
    "op3_suffix_dedup": suffix.ORACLE_SQL,
    "op5_decontamination": decontamination.ORACLE_SQL,
    "op8_line_dedup": linededup.ORACLE_SQL,
    "op11_mixing": mixing.ORACLE_SQL,
    "op13_divergence": divergence.ORACLE_SQL,
}
