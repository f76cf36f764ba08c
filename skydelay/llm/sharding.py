"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets by a seeded hash; there are as many buckets as it takes for each to
fit a task's memory (``bucket_bytes``). Pass 2 takes one bucket at a time, shuffles it with a seeded Fisher-Yates
shuffle and writes it. Uniform scattering followed by a uniform shuffle of each bucket is a uniform shuffle of the whole
table, whatever order or copies it holds.

Shards are contiguous runs of the shuffled order (law ``rows``: their counts differ by at most one), so a bucket is
written to one or two shards and the number of files stays near buckets + shards. A record's place follows from the
number of records in the buckets before its own, which a pass over the ids alone counts.

The scattering hash takes the record's running number besides its id, so repeated ids and repeated rows scatter like any
other. Null ids and texts are kept. An empty table writes no record.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skydelay.llm.common import pmod_hash
from skydelay.session import checkpoint_dir, cut_lineage

SHARDS = 40
SEED = 11
BUCKET_BYTES = 16 << 20  # UTF-8 text of a bucket: what one task holds


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The records (doc_id, text) with ``shard`` and ``slot``, each bucket in its shuffled order. ``docs`` must be a
    table (its splits number the records)."""
    spark = docs.sparkSession
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("number"))
    size = numbered.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    total, buckets = size["n"], max(1, -(-(size["bytes"] or 0) // bucket_bytes))
    scattered = numbered.withColumn("bucket", pmod_hash(buckets, F.lit(seed), "doc_id", "number"))
    # places before each bucket: a running sum over one row per bucket
    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("records"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(counts.select("bucket", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("start")))

    def fisher_yates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            table = pa.Table.from_batches(held)
            bucket, start = table["bucket"][0].as_py(), table["start"][0].as_py()
            order = np.arange(len(table))
            np.random.default_rng([seed, bucket]).shuffle(order)  # numpy's shuffle of a vector is Fisher-Yates
            place = np.arange(start, start + len(table))
            shard = place * shards // total
            slot = place - -(-shard * total // shards)
            table = table.select(["doc_id", "text"]).take(pa.array(order))
            table = table.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot))
            yield from table.combine_chunks().to_batches(max_chunksize=2000)

        for batch in batches:
            ids = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and a < b and held[-1].column("bucket")[0].as_py() != ids[a]:
                    yield from flush()
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        yield from flush()

    width = min(buckets, 1 << 20)
    return scattered.join(starts, "bucket").select("doc_id", "text", "bucket", "start", "number") \
        .repartition(width, "bucket").sortWithinPartitions("bucket", "number") \
        .mapInArrow(fisher_yates, "doc_id long, text string, shard int, slot long") if total else \
        spark.createDataFrame([], "doc_id long, text string, shard int, slot long")


def write_shards(docs: DataFrame, path: str, **options: int) -> DataFrame:
    """Writes the shuffled records to ``path``/shard=k/ and returns the written table."""
    shuffled(docs, **options).write.partitionBy("shard").parquet(path)
    spark = docs.sparkSession
    return spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)


def op8(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    path = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/shards/{uuid.uuid4().hex}"
    text = F.coalesce(F.col("text"), F.lit(""))
    return write_shards(docs, path).select(
        "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
