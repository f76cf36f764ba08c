"""SimHash near-duplicate detection with deletion-variant signatures.

A text's 64-bit fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Two texts are linked when
their fingerprints differ in at most ``max_bits`` (3) bits. To find all such pairs without comparing everything, the
fingerprint is cut into two halves: of two linked fingerprints one half differs in at most one bit. Every half is
indexed under its one-wildcard variants (the half with bit i left out, for every i), so two halves at most one bit apart
share a variant; an equality join on (half, i, variant) therefore finds every pair, and the whole fingerprints are then
verified. The index is over distinct fingerprints: exact copies never multiply.

Bucket sizes. The index is shuffled once, and only buckets with two or more members are written. Two members are settled
by comparing them; a bucket of more than ``dense`` members is cut again by the one-wildcard variants of its *other* half's halves (16 bits,
then 8 bits), where the same argument holds: members of a sub-bucket agree on all but at most one bit of each part
already cut, so after the last cut at most 2*2*2*2^8 = 2048 distinct fingerprints can meet. That proven bound is what one
task holds at a time. A settled bucket returns a spanning set of its links (at most members - 1), never all pairs:
reachability needs no more.

Nulls and empty texts have fingerprint zero and link like any other. Repeated rows share a fingerprint. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skydelay.llm.common import as_bytes, components
from skydelay.session import cut_lineage

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
DENSE = 256
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANE = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text (0 without words)."""
    words = text.lower().split()  # on bytes: lower-cases A-Z only, splits on the six ASCII space characters
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return digest(b" ".join(words), seed)  # the one hash: every bit is set in all or none
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[:len(words) - shingle_words + 1].tolist(), ends[shingle_words - 1:].tolist())
    hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANE).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BIT_OF_BYTE).ravel()  # ones[8 * byte + bit]
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> Column:
    """The fingerprint as a signed 64-bit long."""
    @F.arrow_udf(T.LongType())
    def compute(texts: pa.Array) -> pa.Array:
        prints = np.fromiter((fingerprint(t, shingle_words, seed) for t in as_bytes(texts)), np.uint64, len(texts))
        return pa.array(prints.view(np.int64))
    return compute(text)


def hex_column(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _half_variants(fps: DataFrame) -> DataFrame:
    """(fp, key): both 32-bit halves under each of their one-wildcard variants. The key is the wildcard's place (0-31 low
    half, 32-63 high half) above the remaining bits; rows are dealt by it, but only the fingerprint and the place move."""
    places = F.explode(F.array(*[F.lit(i).cast("byte") for i in range(64)])).alias("at")
    half = "if(at < 32, fp & 4294967295L, shiftrightunsigned(fp, 32))"
    key = F.expr(f"shiftleft(cast(at AS bigint), 32) | ({half} & ~shiftleft(1L, cast(at % 32 AS int)))")
    return fps.select("fp", places).repartition(key).select("fp", key.alias("key"))


def _variants(fp: Column, low: int, bits: int) -> Column:
    """Array of (place of the wildcard, remaining bits) of the ``bits``-bit part of ``fp`` that starts at ``low``."""
    part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))
    return F.array(*[F.struct(F.lit(low * 64 + i).alias("at"),
                              part.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << i))).alias("rest")) for i in range(bits)])


def _spanning_links(fps: np.ndarray, max_bits: int) -> list[dict[str, int]]:
    """Links found by a breadth-first walk that compares each reached member with those not reached yet."""
    left = np.sort(fps).view(np.uint64)
    found: list[dict[str, int]] = []
    frontier: list[np.uint64] = []
    while len(left):
        if not frontier:
            frontier, left = [left[0]], left[1:]
        at = frontier.pop()
        near = np.bitwise_count(left ^ at) <= max_bits
        reached, left = left[near], left[~near]
        found += [{"a": int(x), "b": int(at.view(np.int64))} for x in reached.view(np.int64)]
        frontier += list(reached)
    return found


def links(fps: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that span every set reachable through pairs at most
    ``max_bits`` (3 or fewer) bits apart."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves differ by at most one bit in one of them only for max_bits <= 3")
    link_type = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))

    @F.pandas_udf(link_type)
    def span(members: pd.Series) -> pd.Series:
        return pd.Series([_spanning_links(np.asarray(m, dtype=np.int64), max_bits) for m in members])

    near = F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= max_bits
    rows = _half_variants(fps).withColumn("side", (F.col("key") >= F.lit(32 << 32)).cast("int"))
    out = None
    for part, piece in ((32, 16), (16, 8), (8, 0)):  # size of the part still whole, size of the pieces it is cut into
        size = F.count(F.lit(1)).over(Window.partitionBy("key"))
        shared = cut_lineage(rows.withColumn("n", size).where("n > 1"))
        pairs = shared.where("n = 2").groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where(near)
        # many keys hold the same members (all wildcards of an equal half), so equal member lists are settled once
        bound = dense if piece else 1 << 31
        lists = shared.where((F.col("n") > 2) & (F.col("n") <= bound)).groupBy("key") \
            .agg(F.sort_array(F.collect_list("fp")).alias("m")).select("m").distinct()
        found = pairs.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionByName(lists.select(F.inline(span("m"))))
        out = found if out is None else out.unionByName(found)
        dense_rows = shared.where(F.col("n") > bound)
        if dense_rows.isEmpty():
            break
        # cut the part that is still whole; `side` tells where it starts
        rows = None
        for code, low in _whole_part(part).items():
            here = dense_rows.where(F.col("side") == code)
            for half in (0, 1):
                more = here.select("fp", "key", F.inline(_variants(F.col("fp"), low + half * piece, piece))) \
                    .select("fp", F.struct("key", "at", "rest").alias("key"), F.lit(code * 2 + half).alias("side"))
                rows = more if rows is None else rows.unionByName(more)
    return out.distinct()


def _whole_part(part: int) -> dict[int, int]:
    """Code of every way of cutting so far -> first bit of the part that is still whole. One code per choice of half,
    the newest choice in the last bit."""
    if part == 32:
        return {0: 32, 1: 0}  # the low half was cut, or the high one
    outer = _whole_part(part * 2)
    return {code * 2 + half: low + (part if half == 0 else 0) for code, low in outer.items() for half in (0, 1)}


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp (signed long), component_id (smallest doc_id reachable, null ids last) and the ``keep`` columns, one
    row per input row."""
    prints = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), *keep,
                                     fingerprint_column(F.col(text_col), shingle_words).alias("fp")))
    first = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comp = cut_lineage(components(links(first.select("fp"), max_bits)))
    # members of a component with more than one fingerprint, with the smallest id of the component
    member = comp.unionByName(comp.select(F.col("comp").alias("node"), "comp").distinct())
    named = member.join(first, member["node"] == first["fp"]).groupBy("comp").agg(F.min("first_id").alias("component_id"))
    smallest = member.join(named, "comp").select(F.col("node").alias("fp"), "component_id")
    per_print = first.join(smallest, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return prints.join(per_print, "fp", "left").select("doc_id", "fp", "component_id", *keep)


def op1(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", hex_column(F.col("fp")).alias("fingerprint"), "component_id")
