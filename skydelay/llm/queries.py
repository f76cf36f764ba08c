"""Queries opN_<name>: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skydelay.llm import (conversation_repair, exact_dedup, fingerprints, language_id, lm_scoring, merkle, packing, quality_classifier,
                          quality_rules, secrets, sentencepiece_fst, sharding, simhash)
from skydelay.llm.common import read_table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op1(read_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.op2(read_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.op3(read_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.op4(read_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op5(read_table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.op6(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op7(read_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op8(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op9(read_table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op10(read_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op11(read_table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op12(read_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.op13(read_table(spark, sf_dir, "conversations"))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_simhash_dedup": (op1_simhash_dedup, None),
    "op2_sentencepiece": (op2_sentencepiece, None),
    "op3_document_fingerprints": (op3_document_fingerprints, None),
    "op4_lm_scoring": (op4_lm_scoring, None),
    "op5_best_fit_packing": (op5_best_fit_packing, None),
    "op6_quality_classifier": (op6_quality_classifier, None),
    "op7_language_id": (op7_language_id, None),
    "op8_sharding": (op8_sharding, None),
    "op9_quality_rules": (op9_quality_rules, quality_rules.oracle_sql()),
    "op10_secret_scans": (op10_secret_scans, None),
    "op11_merkle_manifest": (op11_merkle_manifest, merkle.oracle_sql()),
    "op12_exact_dedup": (op12_exact_dedup, exact_dedup.ORACLE_SQL),
    "op13_conversation_repair": (op13_conversation_repair, None),
}
