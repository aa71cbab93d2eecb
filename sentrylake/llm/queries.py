"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, licenses, lm, packing, pii, reshard, simhash, tokenstore, toxicity
from .common import scratch, table, tokenizer_path


def op1_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    tokenstore.write_store(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end=2, vocabulary=49_408)
    return tokenstore.report(spark, path)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end=2)


def op5_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard.report(spark, table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), end=50_256, vocabulary=50_257)


QUERIES = {f.__name__: f for f in (op1_hilbert_neighbours, op2_pii, op3_token_store, op4_best_fit_packing, op5_flow_resharding, op6_simhash_near_dedup, op7_benchmark_decontamination, op8_toxicity, op9_license_scan, op10_attention_lm)}
ORACLE: dict[str, str] = {"op9_license_scan": licenses.oracle_sql()}
