"""Repair of conversations whose turns break the grammar ``(s?(ua)+)?`` of role initials (system, user, assistant).

* Faults: each row's first of blank, duplicate (role and text of an earlier row) and truncated (no closing mark).
* Alignment: Wagner-Fischer between a conversation's rows and the target strings (ua)^k and s(ua)^k of every feasible
  length. The cost of what is left depends on the rows left and the letters left, so one table, filled from the end, has
  the distances to all lengths. Cells lie in Ukkonen's band: the incumbent, the cost of a plain repair made in one
  pass, bounds the deletions and insertions that a path may still have (``KEEP``, ``REROLE``, ``DELETE``, ``INSERT`` and
  ``TRUNCATED`` are the costs).
* Audits: of the lengths of least cost the backtraced audits are compared letter by letter; the least in ASCII order stays.

Spark deals the work. Rows are damaged, judged and numbered by DataFrame functions; an earlier equal row is found by a
minimum per (conversation, role, digest), not by gathering a conversation. Alignment needs one byte of a row (its initial
and fault): rows come sorted by conversation and turn, a conversation's bytes are held one conversation at a time, and the
table keeps every sqrt(n)-th row (what lies between is filled again for the backtrace), so its memory is sqrt(rows) x band.
Its time is rows x band, and the band is at most 0.7 x incumbent. The texts are joined with their edits by row number and
hashed as they stream by: no text of a conversation is held.

Defined results: null ids, turns, roles and texts read as one space where they are text; null turns come first; rows of one
turn are ordered by role, digest and place of reading; a null id is a conversation of its own; empty tables give no row; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skydelay.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 29  # of cells outside the band
#: a row's byte: initial (0 other, 1 user, 2 assistant, 3 system) + 4 x fault (0 none, 1 truncated, 2 blank, 3 duplicate)
INITIALS = {"u": 1, "a": 2, "s": 3}
USER, ASSISTANT, SYSTEM = 1, 2, 3


class Alignment:
    """Least-cost edits of one conversation, given its rows' bytes."""

    def __init__(self, codes: np.ndarray):
        initial, fault = codes & 3, codes >> 2
        self.n, self.initial = len(codes), initial
        self.lost = fault >= 2  # must be deleted
        self.late = np.where(fault == 1, TRUNCATED, 0)
        # each lost or truncated row costs a deletion at least
        least = np.where(fault >= 1, DELETE, 0)
        self.before = np.concatenate(([0], np.cumsum(least)))
        self.incumbent = self._plain_repair()
        # letters left that a path of the incumbent's cost may have: at most `low` fewer than rows left, `high` more
        spare = self.incumbent - self.before
        self.low = np.maximum(0, spare // DELETE)
        self.high = max(0, int(self.incumbent - self.before[-1]) // INSERT)
        self.every = max(1, int(self.n ** 0.5))
        self.kept = {self.n: self._last_row()}
        row = self.kept[self.n]
        for i in range(self.n - 1, -1, -1):
            row = self._row(i, row)
            if i % self.every == 0:
                self.kept[i] = row
        self.block: dict[int, tuple[int, np.ndarray]] = {}

    def _plain_repair(self) -> int:
        """Cost of a repair that deletes faulty and repeated turns: any upper bound will do."""
        cost, want = 0, USER
        for initial, lost, late in zip(self.initial.tolist(), self.lost.tolist(), self.late.tolist()):
            if lost or late or initial != want:
                cost += DELETE
            else:
                want = USER + ASSISTANT - want
        return cost + (INSERT if want == ASSISTANT else 0)

    # A row of the table is (first r, costs): costs[x] is that of rows i.. against the last r = first + x letters of (ua)*.
    # The letter before r left ones is u for even r, a for odd r.

    def _span(self, i: int) -> tuple[int, int]:
        left = self.n - i
        return max(0, left - int(self.low[i])), left + self.high

    def _last_row(self) -> tuple[int, np.ndarray]:
        lo, hi = self._span(self.n)
        return lo, INSERT * np.arange(lo, hi + 1)

    def _at(self, row: tuple[int, np.ndarray], lo: int, hi: int) -> np.ndarray:
        """The costs for lo..hi of a row, FAR outside its band."""
        first, costs = row
        out = np.full(hi - lo + 1, FAR)
        a, b = max(lo, first), min(hi, first + len(costs) - 1)
        if a <= b:
            out[a - lo:b - lo + 1] = costs[a - first:b - first + 1]
        return out

    def _substitute(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Cost of putting row i at the first of r letters, for r = lo..hi (r >= 1)."""
        if self.lost[i]:
            return np.full(hi - lo + 1, FAR)
        letter = np.where(np.arange(lo, hi + 1) % 2 == 0, USER, ASSISTANT)
        return np.where(letter == self.initial[i], KEEP, REROLE) + self.late[i]

    def _row(self, i: int, below: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
        lo, hi = self._span(i)
        costs = self._at(below, lo, hi) + DELETE
        first = max(lo, 1)
        over = self._at(below, first - 1, hi - 1) + self._substitute(i, first, hi)
        costs[first - lo:] = np.minimum(costs[first - lo:], over)
        steps = INSERT * np.arange(len(costs))
        return lo, np.minimum.accumulate(costs - steps) + steps

    def row(self, i: int) -> tuple[int, np.ndarray]:
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            end = min(self.n, (i // self.every + 1) * self.every)
            below, self.block = self.kept[end], {}
            for k in range(end - 1, i // self.every * self.every, -1):
                below = self.block[k] = self._row(k, below)
        return self.block[i]

    def costs(self, i: int, left: np.ndarray) -> np.ndarray:
        """The table at row i for these numbers of letters left; FAR outside the band and below 0."""
        first, costs = self.row(i)
        at = left - first
        inside = (at >= 0) & (at < len(costs))
        return np.where(inside, costs[np.where(inside, at, 0)], FAR)

    def _lengths(self, i: int, least: int) -> np.ndarray:
        """The feasible even numbers of letters left at row i, from ``least`` on."""
        first, costs = self.row(i)
        low = max(first, least)
        return np.arange(low + low % 2, first + len(costs), 2)

    def solve(self) -> tuple[int, str]:
        """Cost and audit."""
        system = np.flatnonzero((self.initial == SYSTEM) & ~self.lost & (DELETE * np.arange(self.n) <= self.incumbent))
        # (cost before the letters of (ua)*, edits before them, first row after them, least length)
        starts = [(0, "", 0, 0)] + [(DELETE * p + int(self.late[p]), "D" * p + "K", p + 1, 2) for p in system.tolist()]
        best = [int((base + self.costs(i, r)).min()) if len(r := self._lengths(i, least)) else FAR for base, _, i, least in starts]
        cost = min(best)
        audits = []
        for (base, head, i, least), own in zip(starts, best):
            if own == cost:
                lengths = self._lengths(i, least)
                audits.append(head + self._walk(i, lengths[base + self.costs(i, lengths) == cost]))
        return cost, min(audits)

    def _walk(self, i: int, here: np.ndarray) -> str:
        """The least audit of rows i.. among the best paths to the lengths ``here``: paths that have the same letters so
        far are walked together."""
        audit = []
        while i < self.n:
            now = self.costs(i, here)
            go = here[self.costs(i + 1, here) + DELETE == now]
            if len(go):
                audit.append("D")
                here, i = go, i + 1
                continue
            go = here[self.costs(i, here - 1) + INSERT == now]
            if len(go):
                audit.append("I")
                here = go - 1
                continue
            own = np.where(here % 2 == 0, USER, ASSISTANT) == self.initial[i]
            over = self.costs(i + 1, here - 1) + self.late[i] + np.where(own, KEEP, REROLE) == now
            keep = here[over & own]
            audit.append("K" if len(keep) else "R")
            here, i = (keep if len(keep) else here[over]) - 1, i + 1
        return "".join(audit) + "I" * int(here.min())


def edits_per_row(audit: str) -> list[str]:
    """The audit in one part per row: the insertions before a row and its own letter; the last row has what follows it."""
    parts, part = [], ""
    for letter in audit:
        part += letter
        if letter != "I":
            parts.append(part)
            part = ""
    parts[-1] += part
    return parts


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the contract's damage, by crc32 of ``conv_id:turn`` modulo 20."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = (F.crc32(key.cast("binary")) % 20).alias("kind")
    text = F.coalesce("text", space)
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), kind).where("kind <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
                       .otherwise(F.col("text")).alias("text"),
                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")) \
        .select("conv_id", "turn", "role", "text")


def _byte(role: Column, fault: Column) -> Column:
    initial = F.substring(role, 1, 1)
    code = F.lit(0)
    for letter, value in INITIALS.items():
        code = F.when(initial == letter, F.lit(value)).otherwise(code)
    return (code + 4 * fault).cast("byte")


def judged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts: number, conv_id, role, text; codes: number, conv_id, turn, role, digest, code), both in the shared folder."""
    whole = cut_lineage(rows.select("*", F.monotonically_increasing_id().alias("number"),
                                    F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")))
    last = F.regexp_extract("text", "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z", 1)
    fault = F.when(last == "", F.lit(2)).when(~last.isin(".", "!", "?"), F.lit(1)).otherwise(F.lit(0)).alias("fault")
    plain = whole.select("number", "conv_id", "turn", "role", "digest", fault)
    # the first of equal rows, per conversation; nulls are least in a struct
    first = plain.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "number")).alias("first"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    repeated = F.col("first").isNotNull() & (F.col("first.number") != F.col("number"))
    codes = plain.join(first.hint("merge"), same, "left") \
        .withColumn("fault", F.when((F.col("fault") != 2) & repeated, F.lit(3)).otherwise(F.col("fault"))) \
        .select("number", "conv_id", "turn", "role", "digest", _byte(F.col("role"), F.col("fault")).alias("code"))
    return whole.select("number", "conv_id", "role", "text"), codes


def _conversations(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """Runs of equal conv_id of sorted batches, as lists of slices with the given columns."""
    now, held = None, []
    for batch in batches:
        ids = batch.column("conv_id")
        filled = ids.fill_null(0).to_numpy(zero_copy_only=False)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(filled) != 0) | (np.diff(null.astype(np.int8)) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            if a == b:
                continue
            key = (bool(null[a]), int(filled[a]))
            if held and key != now:
                yield (None if now[0] else now[1]), held
                held = []
            now = key
            held.append(batch.slice(a, b - a).select(columns))
    if held:
        yield (None if now[0] else now[1]), held


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER}


def _summary(turns: np.ndarray, codes: np.ndarray) -> tuple[int, ...]:
    fault, initial = codes >> 2, codes & 3
    gaps = 0 if not len(turns) else int(turns[-1]) - int(turns[0]) + 1 - len(np.unique(turns))
    steps = initial[:-1].astype(int) * 4 + initial[1:]
    illegal = int((~np.isin(steps, list(LEGAL))).sum())
    return gaps, int((fault == 2).sum()), int((fault == 3).sum()), int((fault == 1).sum()), illegal


def align(codes: DataFrame) -> DataFrame:
    """One row per conversation with its summary and audit, and its rows' edits: an array of (number, place, letters),
    cut in arrays of at most 4,096 rows; only the first of a conversation's rows has the summary (``audit`` not null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, parts in _conversations(batches, ["number", "turn", "code"]):
            table = pa.Table.from_batches(parts).combine_chunks()
            code = table["code"].to_numpy().astype(np.uint8)
            turn = table["turn"].drop_null().to_numpy()
            cost, audit = Alignment(code).solve()
            letters = edits_per_row(audit)
            number = table["number"].to_numpy()
            for start in range(0, len(code), 4096):
                end = min(len(code), start + 4096)
                edits = [{"number": a, "place": b, "letters": c}
                         for a, b, c in zip(number[start:end].tolist(), range(start, end), letters[start:end])]
                values = [conv, *(_summary(turn, code) + (cost, audit) if start == 0 else [None] * 7), edits]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    edit = pa.list_(pa.struct([("number", pa.int64()), ("place", pa.int64()), ("letters", pa.string())]))
    types = [pa.int64()] * 7 + [pa.string(), edit]
    names = [*[f.split()[0] for f in SUMMARY.split(", ")], "edits"]
    return codes.select("conv_id", "turn", "role", "digest", "number", "code").repartition("conv_id") \
        .sortWithinPartitions("conv_id", "turn", "role", "digest", "number").select("conv_id", "turn", "number", "code") \
        .mapInArrow(run, f"{SUMMARY}, edits array<struct<number: long, place: long, letters: string>>")


def repaired_hashes(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows (conv_id, place, letters, role, text), hashed in one pass over sorted rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, parts in _lazily(batches):
            sha, want, first = hashlib.sha256(), "user", True
            for part in parts:
                for letters, role, text in zip(*(part.column(c).to_pylist() for c in ("letters", "role", "text"))):
                    for letter in letters:
                        if letter == "D":
                            continue
                        if letter == "K" and role[:1] == "s":
                            line = f"{role}:{text}"  # the s of the target; a user's turn comes next
                        else:
                            line = f"{role}:{text}" if letter == "K" else f"{want}:{text if letter == 'R' else ''}"
                            want = "assistant" if want == "user" else "user"
                        sha.update((line if first else "\n" + line).encode())
                        first = False
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return rows.select("conv_id", "place", "letters", "role", "text").repartition("conv_id") \
        .sortWithinPartitions("conv_id", "place").mapInArrow(run, "conv_id long, repaired_sha256 string")


def _lazily(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[pa.RecordBatch]]]:
    """As ``_conversations``, but a conversation's slices are handed on as they come and none is held."""
    def slices() -> Iterator[tuple[object, pa.RecordBatch]]:
        for batch in batches:
            for conv, parts in _conversations(iter([batch]), batch.schema.names):
                yield from ((conv, p) for p in parts)
    from itertools import groupby
    for conv, group in groupby(slices(), key=lambda x: (x[0] is None, x[0])):
        yield conv[1], (part for _, part in group)


def repair(turns: DataFrame) -> DataFrame:
    """Of turns (conv_id, turn, role, text; no null role or text): one row per conversation with gaps, blank, duplicate,
    truncated, illegal, cost, audit and repaired_sha256."""
    texts, codes = judged(turns)
    aligned = cut_lineage(align(codes))
    edits = aligned.select(F.inline("edits"))
    hashes = repaired_hashes(texts.join(edits.hint("merge"), "number"))
    c = F.col("conv_id").eqNullSafe(F.col("c"))
    return aligned.where("audit IS NOT NULL").drop("edits").join(hashes.withColumnRenamed("conv_id", "c").hint("merge"), c).drop("c")


def op13(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per original conv_id."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    done = repair(damaged(turns)).withColumnRenamed("conv_id", "c")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return turns.select("conv_id").distinct().join(done.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")), "left") \
        .select("conv_id", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
