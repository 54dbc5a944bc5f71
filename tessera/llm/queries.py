"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, licenses, line_dedup, near_dups, oracles, packing, quality_model, quality_rules, token_counts, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"), k=3, similarity=90)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.line_dedup(docs).selectExpr("row.doc_id", "n_lines", "n_dropped", "text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_rules.quality_rules(docs, _table(spark, sf_dir, "labels"))
    return found.select("row.doc_id", *quality_rules.COUNTS, "base_failed", "kept", "score")


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_model(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(_table(spark, sf_dir, "conversations"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scans": op1_license_scans,
        "op2_decontamination": op2_decontamination,
        "op3_token_counts": op3_token_counts,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_token_files": op5_token_files,
        "op6_line_dedup": op6_line_dedup,
        "op7_quality_rules": op7_quality_rules,
        "op8_quality_model": op8_quality_model,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scans": oracles.license_scans(),
        "op2_decontamination": oracles.decontamination(),
        "op4_ngram_jaccard": oracles.ngram_jaccard(),
        "op6_line_dedup": oracles.line_dedup(),
        "op9_chat_formatting": oracles.chat_formatting(),
    }
