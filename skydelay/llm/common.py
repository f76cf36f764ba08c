"""Helpers shared by the document operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skydelay.session import cut_lineage


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``modulus`` (null ids fold like the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % F.lit(modulus)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Arrow strings as UTF-8 byte strings without decoding them; null becomes the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b if b is not None else b"" for b in column.cast(kind).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [t if t is not None else "" for t in column.to_pylist()]


def offsets_of(lengths: list[int] | np.ndarray) -> np.ndarray:
    """Start of each part when parts of these lengths are laid end to end, with the total as last entry."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments (empty ones are 0) of a vector or of a matrix's rows, exact per segment."""
    n = len(offsets) - 1
    out = np.zeros((n, *values.shape[1:]), dtype=values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def pmod_hash(n: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list (a, b long), as (node, comp): comp is the smallest node.

    Each round sends every node's smallest neighbour to its neighbours (large star) and then re-hangs each node's
    smaller neighbours on the smallest one (small star), so a chain of length d needs about log d rounds and no round
    gathers more than the edges themselves. Rows of a round are written to the shared folder, which cuts the lineage.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        # large star: every strictly larger neighbour of a node hangs on the smallest of the node and its neighbours
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = cut_lineage(small)
        # converged: every node hangs on exactly one root and no root hangs on anything
        stars = new.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0 and \
            new.select("b").distinct().join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi") \
            .limit(1).count() == 0
        e = new
        if stars:
            break
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))


SMALL_ROWS = 100_000  # of a table that may be sent to every task


def join_small(rows: DataFrame, small: DataFrame, on: Column | str, most: int = SMALL_ROWS) -> DataFrame:
    """Inner join with a stored table that is small as a rule: sent to every task if it has at most ``most`` rows
    (counted), else a sort-merge join."""
    return rows.join(F.broadcast(small), on) if small.count() <= most else rows.hint("merge").join(small, on)


def batches_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
