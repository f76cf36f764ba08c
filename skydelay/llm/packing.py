"""Best-fit packing of tokenized documents into fixed-size sequences by exact-complement hashing.

A document is its token ids followed by a closing id; only documents longer than a sequence are cut. What the packer
needs of the corpus is how many pieces have each length (at most ``capacity`` numbers), so the plan is made on that
histogram: from the longest length down, the gap is looked up among single lengths, pair sums and triple sums that are
still available, and combinations that fill it exactly are consumed as often as their counts allow; a gap without an
exact complement takes the longest available length that fits (best fit) and looks again. Every consumed combination
uses up at least one length, so a plan has some thousand patterns at any corpus size.

Pieces are then ranked within their length (per input partition, plus the partition's offset, so a length shared by a
third of all rows is never one task) and rank ranges map to pattern slots.

Nulls and empty texts are the closing id alone. Repeated rows are placed each on its own. An empty table gives none.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skydelay.llm.common import as_text, batches_of, offsets_of
from skydelay.session import cut_lineage

CAPACITY = 2048
CLOSING_ID = 0
CACHE_PARTS = 500_000  # encoded parts a task remembers


# Texts of the characters below (no controls, combining marks or other scripts) are split here by the vocabulary's own
# rule: endings after an apostrophe, runs of letters, single digits, runs of anything else but space.
_OTHER = re.compile("[^ -~\t\n\r\u00a1-\u00ac\u00ae-\u012f\u0131-\u017f]")
_LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f"
_DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^ \\t\\n\\r{_LETTERS}{_DIGITS}]+")
_SPACE = re.compile("[ \t\n\r]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself where printable, else 256, 257, ..."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PartEncoder(dict):
    """Token ids of the parts that a text is split into, as little-endian unsigned 32-bit bytes, each encoded once.

    The vocabulary lower-cases, drops white space and splits at it, so the ids of a text are those of its parts one
    after another. A word with other characters, or with ``<|`` (special tokens), takes the tokenizer's whole path."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()

    def __missing__(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        ids = self[part] = b"".join(t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(shown))
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > CACHE_PARTS:
            self.clear()
        if _OTHER.search(text) or "<|" in text:
            return b"".join(map(self._word, _SPACE.split(text)))
        return b"".join(map(self.__getitem__, _PARTS.findall(text.lower())))

    def _word(self, word: str) -> bytes:
        if _OTHER.search(word) or "<|" in word:
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, _PARTS.findall(word.lower())))


@lru_cache(maxsize=2)
def _encoder(path: str) -> PartEncoder:
    return PartEncoder(path)


@contextmanager
def _tokenizer(path: str) -> Iterator[PartEncoder]:
    """The worker's encoder for one task; what it remembers goes with the task, as idle workers keep their memory."""
    encoder = _encoder(path)
    try:
        yield encoder
    finally:
        encoder.clear()


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID,
           with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): one row per piece of a document."""
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    closing = closing_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _tokenizer(tokenizer_path) as encoder:
            for batch in batches_of(batches, 512):
                ids, piece, start, length, crc, values = [], [], [], [], [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), as_text(batch.column(1))):
                    found = encoder.encode(text) + closing
                    for k in range(0, len(found), 4 * capacity):
                        part = found[k:k + 4 * capacity]
                        ids.append(doc_id)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            values.append(part)
                cols = [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    flat = np.frombuffer(b"".join(values), dtype="<u4").astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(offsets_of(length).astype(np.int32), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, kinds)


def _exact(gap: int, left: np.ndarray) -> list[int]:
    """One, two or three available lengths with this sum, the longest first; empty if there are none."""
    if left[gap]:
        return [gap]

    def pair(total: int, free: np.ndarray) -> list[int]:
        big = np.arange(total - 1, (total - 1) // 2, -1)
        small = total - big
        fits = np.flatnonzero((free[big] > 0) & (free[small] > (big == small)))
        return [int(big[fits[0]]), int(small[fits[0]])] if len(fits) else []

    if found := pair(gap, left):
        return found
    for big in np.flatnonzero(left[1:gap - 1])[::-1] + 1:
        if 3 * big < gap:
            break
        left[big] -= 1
        found = pair(gap - int(big), left)
        left[big] += 1
        if found:
            return [int(big), *found]
    return []


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a sequence, how many such sequences) that use every piece once. ``counts[l]`` is the number
    of pieces of length l; the capacity is the last index."""
    capacity, left, out = len(counts) - 1, counts.astype(np.int64).copy(), []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            pattern, gap = [longest], capacity - longest
            left[longest] -= 1
            while gap:
                found = _exact(gap, left)
                if not found:  # best fit: the longest that fits
                    fitting = np.flatnonzero(left[1:gap + 1])
                    if not len(fitting):
                        break
                    found = [int(fitting[-1]) + 1]
                for x in found:
                    left[x] -= 1
                pattern += found
                gap -= sum(found)
            # the same pattern as often as what is left allows
            use = np.bincount(pattern, minlength=capacity + 1)
            kinds = np.flatnonzero(use)
            more = int((left[kinds] // use[kinds]).min())
            left[kinds] -= more * use[kinds]
            out.append((pattern, 1 + more))
    return out


def _slots(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and for each the first sequence and the offset within it."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for lengths, times in patterns:
        at = 0
        for x in lengths:
            rows.append(((x << 48) + used.get(x, 0), first, at))
            used[x] = used.get(x, 0) + times
            at += x
        first += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def _place(length: Column, rank: Column, patterns: list[tuple[list[int], int]]) -> Column:
    keys, first, at = _slots(patterns)

    @F.arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        key = (lengths.to_numpy() << 48) + ranks.to_numpy()
        slot = np.searchsorted(keys, key, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(first[slot] + key - keys[slot]), pa.array(at[slot])],
                                          ["sequence_id", "offset"])
    return place(length, rank)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a *written* table of pieces with a ``length`` column."""
    parts = parts.withColumn("__row", F.monotonically_increasing_id())
    parts = cut_lineage(parts.withColumn("__part", F.shiftright("__row", 33)))
    sizes = parts.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n"))
    found = sizes.groupBy("length").agg(F.sum("__n").alias("n")).toPandas()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    counts[found["length"].to_numpy()] = found["n"].to_numpy()
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = Window.partitionBy("length", "__part").orderBy("__row")
    ranked = parts.withColumn("__rank", F.row_number().over(own) - 1).join(starts, ["length", "__part"])
    placed = ranked.withColumn("__at", _place(F.col("length"), (F.col("__rank") + F.col("__before")).cast("long"),
                                              plan(counts)))
    return placed.select(*[c for c in parts.columns if not c.startswith("__")], "__at.sequence_id", "__at.offset")


def op5(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut_lineage(pieces(docs, tokenizer_path))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
