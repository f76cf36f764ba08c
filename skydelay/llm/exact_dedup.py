"""Exact deduplication against a persistent digest index.

The index is a table of one row per distinct text (``digest``: SHA-256 of the text, with the id of the row that stays),
bucketed and sorted by digest. A delivery of new documents is grouped by digest, its groups are anti-joined with the
index by a sort-merge join in which the index is neither shuffled nor broadcast (its buckets are the join's partitions),
and what is new is appended. Which row stays: one that the index holds before any of a later delivery, and within a
delivery the largest id. Adding a delivery again adds nothing, so a job that died half way is simply run again.

Copies never meet in one task: groups are combined before they are shuffled, the anti-join sees each digest once, and the
verdicts come from a join of two shuffled sides, whose large partitions adaptive execution splits. DataFrame functions only.

Defined results: null texts count as empty; null ids are smaller than any other; of repeated rows with one id the first
read stays; empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skydelay.llm.common import shuffle_width
from skydelay.session import cut_lineage, owned_path

INDEX_SCHEMA = "digest binary, keep_id long, delivery string, row_no long"


def digest_column(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", delivery: str | None = None) -> DataFrame:
    """One row per document (doc_id, digest, delivery, row_no), written to the shared folder: the texts are read once.
    ``delivery`` and ``row_no`` name a row, whatever its id."""
    return cut_lineage(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_column(F.col(text_col)).alias("digest"),
                                   F.lit(delivery or uuid.uuid4().hex).alias("delivery"),
                                   F.monotonically_increasing_id().alias("row_no")))


class DigestIndex:
    """A bucketed table of digests. ``buckets`` is fixed when the table is made: as many as the session's shuffle
    partitions unless named, since each bucket is one partition of every later join."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table

    @classmethod
    def create(cls, spark: SparkSession, table: str, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        writer = spark.createDataFrame([], INDEX_SCHEMA).write.format("parquet") \
            .bucketBy(buckets or shuffle_width(spark), "digest").sortBy("digest")
        (writer.option("path", path) if path else writer).saveAsTable(table)
        return cls(spark, table)

    def frame(self) -> DataFrame:
        return self.spark.table(self.table)

    def buckets(self) -> int:
        described = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"DESCRIBE EXTENDED {self.table}").collect()}
        return int(described["Num Buckets"])

    def new_groups(self, rows: DataFrame) -> DataFrame:
        """What of a delivery (see ``digests``) the index does not hold: one row per new digest, its largest row."""
        # the largest row of a digest by (id, first read); nulls are least in a struct
        best = F.max(F.struct("doc_id", (-F.col("row_no")).alias("late"), "delivery")).alias("best")
        # written, or else the anti-join would be moved below the grouping and copies would meet in it
        groups = cut_lineage(rows.groupBy("digest").agg(best))
        return groups.join(self.frame().select("digest").hint("merge"), "digest", "left_anti") \
            .select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.delivery").alias("delivery"),
                    (-F.col("best.late")).alias("row_no"))

    def add(self, rows: DataFrame) -> None:
        """Appends a delivery's new digests, by one task per bucket."""
        n = self.buckets()
        self.new_groups(rows).repartition(n, "digest").write.format("parquet").mode("append") \
            .bucketBy(n, "digest").sortBy("digest").saveAsTable(self.table)

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """doc_id, keep_id, group_size (rows of ``rows`` with the text), kept, digest: one row per row of ``rows``, all
        of which must have been added."""
        sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        held = cut_lineage(sizes.join(self.frame().select("digest", "keep_id", F.col("delivery").alias("keep_delivery"),
                                                          F.col("row_no").alias("keep_row")).hint("merge"), "digest"))
        # both sides are shuffled here, so that the rows of a text with very many copies are split over tasks
        kept = (F.col("delivery") == F.col("keep_delivery")) & (F.col("row_no") == F.col("keep_row"))
        return rows.join(held.hint("merge"), "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def op12(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, over an index of its own that takes the table in two deliveries:
    the upper half of the range of ids first, so that of equal texts the largest id stays."""
    spark = docs.sparkSession
    rows = digests(docs)
    ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    middle = 0 if ends["low"] is None else (ends["low"] + ends["high"]) // 2
    index = DigestIndex.create(spark, f"digest_index_{uuid.uuid4().hex}", owned_path(spark, "digest_index"))
    upper = F.coalesce(F.col("doc_id") > middle, F.lit(False))
    index.add(rows.where(upper))
    index.add(rows.where(~upper))
    return index.verdicts(rows).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
