"""The corpus pipeline: documents that are good, unlike each other and free of secrets, packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
``docs``. All but the last return the columns of documents, with every row and text of the predecessor that the stage
keeps; the last returns the pieces with their places in sequences. Repeated rows are kept or dropped like any others:
near-dedup leaves one row of a group, whatever its ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skydelay.llm import packing, quality_classifier, quality_rules, secrets, simhash
from skydelay.llm.common import read_table
from skydelay.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    kept = quality_classifier.classify(docs, read_table(spark, sf_dir, "labels"), COLUMNS[1:])
    return kept.where("predicted = 1").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality_rules.filtered(docs, COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves of each near-duplicate group the row of the smallest id (of repeated rows, the first read)."""
    numbered = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_no"))
    groups = simhash.near_duplicates(numbered, keep=("row_no",))
    # null ids form groups of their own fingerprint; they come after all others
    key = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "row_no")
    stays = groups.groupBy(F.coalesce("component_id", F.lit((1 << 63) - 1)).alias("component_id"),
                           F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")) \
        .agg(F.min(key).alias("first")).select("first.row_no")
    # a sort-merge join at every size: the rows that stay are no bounded table
    return numbered.join(cut_lineage(stays).hint("merge"), "row_no", "left_semi").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret found; n_chars follows the masked text."""
    net = secrets.fit(docs)
    spans = docs.select(*COLUMNS, secrets.spans_column(F.col("text"), net).alias("spans"))
    masked = spans.withColumn("text", secrets.redacted_column(F.col("text"), F.col("spans")))
    return masked.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))) \
        .select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences: one row per piece."""
    return packing.op5(docs, WORD_VOCABULARY)


STAGES = [("quality_classifier", quality), ("quality_rules", rules), ("simhash_near_dedup", near_dedup),
          ("secret_scan", secret_scan), ("best_fit_packing", pack)]
ORACLE_SQL = None  # trained models and tokenizers are beyond SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
