"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph (a line with something on it) is hashed to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors, each lane modulo a power of two. So it does not depend on the paragraphs' order, and adding or
removing a paragraph adds or subtracts its vector without reading the rest. A vector has two parts:

* 8 lanes modulo 2^64 from a 512-bit hash of the whole paragraph: equal multisets of paragraphs, equal lanes;
* 256 lanes modulo 2^32 into which every three-word window of the paragraph adds +1 or -1 at a hashed place. The squared
  length of the difference of two such vectors estimates how many windows the documents do not share, which gives a
  likeness of 1 - |a - b|^2 / (|a|^2 + |b|^2), kept within 0 to 1.

``edited`` builds the contract's edited text from the next document by descending id and updates the fingerprint
incrementally. Documents are dealt into runs of ids by exact id bounds; each run carries a copy of the first document of
the next one, so texts move once and no task sees more than a run.

Nulls are empty texts (all lanes zero; two of them have likeness 1). Rows of equal id follow each other by text hash;
null ids come last. A table of one document is followed by itself; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skydelay.llm.common import as_text
from skydelay.session import cut_lineage

LANES, SKETCH = 8, 256
RUN_ROWS, MOST_RUNS = 2048, 1_000_000  # documents in a run at least, runs at most (their bounds go to every task)
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))

Vector = tuple[np.ndarray, np.ndarray]  # uint64 lanes, uint32 sketch (no text has 2^31 windows)


def paragraphs(text: str) -> list[bytes]:
    return [p for p in text.encode("utf-8", "surrogatepass").split(b"\n") if p.strip()]


def vector(parts: Counter[bytes]) -> Vector:
    """Sum of the vectors of a multiset of paragraphs."""
    lanes = np.zeros(LANES, np.uint64)
    digests = b"".join(hashlib.blake2b(p, digest_size=8 * LANES).digest() for p in parts)
    if not digests:
        return lanes, np.zeros(SKETCH, np.uint32)
    times = np.fromiter(parts.values(), np.int64, len(parts))
    lanes += (np.frombuffer(digests, "<u8").reshape(-1, LANES) * times.astype(np.uint64)[:, None]).sum(0, dtype=np.uint64)
    words = [p.split() for p in parts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.fromiter(map(crc32, chain.from_iterable(words)), np.uint64, int(lengths.sum()))
    # windows of three words within a paragraph; a shorter paragraph is one window
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(first, lengths)
    long = np.repeat(lengths, lengths)
    padded = np.concatenate([codes + np.uint64(1), np.zeros(2, np.uint64)])
    second = np.where(place + 1 < long, padded[1:-1], np.uint64(0))
    third = np.where(place + 2 < long, padded[2:], np.uint64(0))
    mixed = padded[:-2] * _A + second * _B + third * _C
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _D
    mixed ^= mixed >> np.uint64(32)
    keep = (place + 3 <= long) | (place == 0)
    mixed, weight = mixed[keep], np.repeat(times, lengths)[keep]
    sign = np.where(mixed & np.uint64(1 << 20), weight, -weight)
    sketch = np.bincount((mixed & np.uint64(SKETCH - 1)).astype(np.int64), sign, SKETCH).astype(np.int64)
    return lanes, (sketch & 0xFFFFFFFF).astype(np.uint32)


def add(a: Vector, b: Vector) -> Vector:
    return a[0] + b[0], a[1] + b[1]


def subtract(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1]


def likeness(a: Vector, b: Vector) -> float:
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    x, y, d = (v.view(np.int32).astype(np.float64) for v in (a[1], b[1], a[1] - b[1]))
    size = x @ x + y @ y
    return float(min(1.0, max(0.0, 1 - (d @ d) / size))) if size else 0.0


def packed(v: Vector) -> str:
    return base64.b64encode(v[0].astype("<u8").tobytes() + v[1].astype("<u4").tobytes()).decode()


def fingerprint_column(text: Column) -> Column:
    """The fingerprint of a text column as a string."""
    @F.arrow_udf(T.StringType())
    def compute(texts: pa.Array) -> pa.Array:
        return pa.array([packed(vector(Counter(paragraphs(t)))) for t in as_text(texts)], pa.string())
    return compute(text)


def edit(text: str, following: str) -> str:
    """The last third (rounded down) replaced by the first as many characters of the following document."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _runs(docs: DataFrame) -> DataFrame:
    """doc_id, text, run, guard, tie: documents dealt to runs of descending ids, with each run's following document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    runs = max(1, min(MOST_RUNS, n // RUN_ROWS))
    shares = [i / runs for i in range(1, runs)]
    found = docs.select(F.percentile_approx("doc_id", shares, max(10_000, 20 * runs)).alias("b")).first()["b"] if shares else None
    bounds = np.unique(np.array(found or [], dtype=np.int64))

    @F.arrow_udf(T.IntegerType())
    def run_of(ids: pa.Array) -> pa.Array:
        known = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        run = len(bounds) - np.searchsorted(bounds, known, side="left")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1, run).astype(np.int32))

    tie = F.xxhash64("text")
    dealt = docs.withColumn("run", run_of("doc_id"))
    # the first id of every run, handed to the run before it (the last run is followed by the first): a row per run
    heads = dealt.groupBy("run").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy("run")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("head", F.lag("run").over(order).alias("before"), F.last("run").over(whole).alias("last"))
    heads = cut_lineage(heads.select("head", F.coalesce("before", "last").alias("run")))
    first = dealt.drop("run").join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head"))) \
        .groupBy("run").agg(F.min(F.struct(tie.alias("tie"), "doc_id", "text")).alias("x")) \
        .select("x.doc_id", "x.text", "run", F.lit(1).alias("guard"), "x.tie")
    rows = dealt.select("doc_id", "text", "run", F.lit(0).alias("guard"), tie.alias("tie")).unionByName(first)
    width = max(runs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(width, "run").sortWithinPartitions("run", "guard", F.col("doc_id").desc_nulls_last(), "tie")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, str, list[bytes], Vector] | None = None
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, guard in zip(batch.column(0).to_pylist(), as_text(batch.column(1)), batch.column(2).to_pylist()):
                parts = paragraphs(text)
                print_ = vector(Counter(parts))
                if held is not None:
                    old_id, old, old_parts, old_print = held
                    new = edit(old, text)
                    before, after = Counter(old_parts), Counter(paragraphs(new))
                    updated = add(subtract(old_print, vector(before - after)), vector(after - before))
                    rows.append((old_id, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                                 packed(old_print), packed(updated), likeness(old_print, updated), likeness(old_print, print_)))
                held = None if guard else (doc_id, text, parts, print_)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                              "near_edited", "near_next"])

    return _runs(docs).select("doc_id", "text", "guard").mapInArrow(
        compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def op3(docs: DataFrame) -> DataFrame:
    return edited(docs)
