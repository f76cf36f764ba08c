"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three transducers are compiled from a model file: the normaliser (dummy prefix, spaces to their visible sign, runs of
spaces squeezed if the model says so), the lexicon (a prefix tree whose paths are pieces and whose output is their id)
and the byte fallback (a character outside the lexicon to the ids of its UTF-8 bytes). They are composed with each input
as far as the input reaches, and the shortest path in the tropical semiring is taken from left to right.

For a byte-pair model the path must spell what merging by score would leave. That is a property of neighbours: a sequence
of pieces is the merged one exactly if merging each two neighbours' text gives those two back. So a state remembers the
piece it came by, an arc to a piece that would have merged otherwise weighs infinity (arcs are weighed once and
remembered), all others weigh 0, and one finite path is left. Unigram models weigh an arc by its negative score.

No piece goes on after a space sign that follows another character, holds a control character, or has one of certain
punctuation marks after a letter (found from the lexicon), so inputs are cut there, and a worker remembers the ids of the
cuts it has seen.

Nulls are encoded like empty texts: no ids. Decoding joins pieces and bytes, turns the signs back into spaces and drops
the dummy prefix, so decode(encode(text)) is the normalised text. Repeated rows are encoded each on its own.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skydelay.llm.common import as_text, batches_of, offsets_of

SPACE = "▁"
CACHE = 500_000  # cuts a Python worker remembers
KEPT = 1 << 16  # cuts, and pairs of pieces, that a worker keeps from one task to the next
INFINITE = float("inf")
# Piece types and model types of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialized message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at:at + size]
        at += size


class Transducer:
    """The compiled normaliser, lexicon and byte fallback of a model file."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        kind, spec = UNIGRAM, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
        if kind not in (UNIGRAM, BPE) or spec.get(2):
            raise ValueError("models of unigram or byte-pair type without a character map can be compiled")
        self.bpe = kind == BPE
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.id_of = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER)}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        # the lexicon as a prefix tree: id of a piece, -1 for a text that pieces only begin with
        self.arcs = {p[:k]: -1 for p in self.id_of for k in range(1, len(p))} | self.id_of
        lowest = min((s for _, s, t in self.pieces if t == NORMAL), default=0.0)
        self.unknown_weight = 10.0 - lowest
        # Inputs may be cut before a space sign, around controls, and between a letter and a mark that no piece joins
        before: dict[str, set[str]] = {}
        for p in self.id_of:
            for x, y in zip(p, p[1:]):
                before.setdefault(y, set()).add(x)
        if before.get(SPACE, set()) - {SPACE}:
            raise ValueError("a piece goes on after a space sign")
        letters = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
        letter = re.compile(f"[{letters}]")
        marks = [c for c in map(chr, range(33, 127)) if not c.isalnum() and not any(map(letter.match, before.get(c, ())))]
        controls = [c for c in map(chr, range(32)) if c not in self.arcs and not any(c in p for p in self.id_of)]
        apart, joined = "".join(map(re.escape, controls)), "".join(map(re.escape, marks))
        run = f"[^{SPACE}{apart}{letters}]*[{letters}]*"
        cuts = f"{SPACE}*{run}(?:[^{SPACE}{apart}{letters}{joined}]{run})*"
        self.cuts = re.compile(f"[{apart}]|{cuts}" if apart else cuts)
        self.known: dict[str, bytes] = {}
        self.weights: dict[int, float] = {}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(len(self.pieces))]
        self.spines: dict[tuple[str, int], list[tuple[str, float, float]] | None] = {}
        self.output = [p.encode() for p, _, _ in self.pieces]
        for byte, i in self.byte_ids.items():
            self.output[i] = bytes([byte])
        for i, (_, _, t) in enumerate(self.pieces):
            if t == CONTROL:
                self.output[i] = b""
            elif t == UNKNOWN:
                self.output[i] = " ⁇ ".encode()

    # normaliser
    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return ((" " if self.prefix else "") + text).replace(" ", SPACE)

    # arcs
    def _merged(self, text: str, last: bool = True) -> list[str]:
        """What merging neighbours by score (the left one of equals first) leaves of a short text; without the ``last``
        merge of all: the two parts before it."""
        parts = list(text)
        while True:
            best, at = -INFINITE, -1
            for i in range(len(parts) - 1):
                j = self.id_of.get(parts[i] + parts[i + 1])
                if j is not None and self.pieces[j][1] > best:
                    best, at = self.pieces[j][1], i
            if at < 0 or (len(parts) == 2 and not last):
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _spine(self, piece: str, side: int) -> list[tuple[str, float, float]] | None:
        """The symbols that stand at the first (side 0) or last (side 1) place while ``piece`` is merged, from its
        character on, with the rank (negative score) at which each arises and is merged away. None if merging the
        piece's text gives something else, or if its ranks do not rise as it is merged."""
        key = (piece, side)
        if key not in self.spines:
            out, symbol, gone = [], piece, INFINITE
            while out is not None:
                rank = -self.pieces[self.id_of[symbol]][1] if len(symbol) > 1 else -INFINITE
                out.append((symbol, rank, gone))
                if len(symbol) == 1:
                    break
                parts = self._merged(symbol, last=False)
                out = out if len(parts) == 2 and rank < gone else None
                symbol, gone = (parts[side], rank) if out else ("", 0.0)
            self.spines[key] = out[::-1] if out else None
        return self.spines[key]

    def weight(self, before: str, piece: str) -> float:
        """Of the arc that reads ``piece`` in a state reached by ``before`` (empty at the start)."""
        if not self.bpe:
            return -self.pieces[self.id_of[piece]][1]
        right = self._spine(piece, 0)
        if before and before not in self.id_of:
            before = ""  # an unknown character merges with nothing
        left = self._spine(before, 1) if before else []
        if right is None or left is None:
            return 0.0 if self._merged(before + piece) == ([before, piece] if before else [piece]) else INFINITE
        # while both are merged on their own, does a merge across their border ever come first?
        i = j = 0
        while i < len(left) and j < len(right):
            across = self.id_of.get(left[i][0] + right[j][0])
            rank = -self.pieces[across][1] if across is not None else INFINITE
            if rank < left[i][2] and rank <= right[j][2] and across is not None:
                return INFINITE
            if left[i][2] <= right[j][2]:
                i += 1
            else:
                j += 1
        return 0.0

    def shortest_path(self, text: str) -> bytes:
        """Output of the shortest path through a cut. A state is a place in the text and the piece that led there; -1
        stands for the start and for a character outside the lexicon, which the byte fallback spells."""
        n = len(text)
        cost, came, last = [INFINITE] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        cost[0] = 0.0
        weights, arcs, pieces = self.weights, self.arcs, self.pieces
        for start in range(n):
            here = cost[start]
            if here == INFINITE:
                continue
            before = last[start]
            end = start
            for end in range(start + 1, n + 1):
                arc = arcs.get(text[start:end])
                if arc is None:
                    break
                if arc >= 0:
                    key = (before + 1) << 24 | arc
                    w = weights.get(key)
                    if w is None:
                        w = weights[key] = self.weight(pieces[before][0] if before >= 0 else "", pieces[arc][0])
                    if here + w < cost[end]:
                        cost[end], came[end], last[end] = here + w, start, arc
            if arcs.get(text[start], -1) < 0 and here + self.unknown_weight < cost[start + 1]:
                cost[start + 1], came[start + 1], last[start + 1] = here + self.unknown_weight, start, -1
        out, at = [], n
        while at:
            out.append(self.id_bytes[last[at]] if last[at] >= 0 else self._spelt(text[came[at]]))
            at = came[at]
        out.reverse()
        return b"".join(out)

    def _spelt(self, character: str) -> bytes:
        ids = [self.byte_ids[b] for b in character.encode()] if self.byte_ids else [self.unknown]
        return b"".join(x.to_bytes(4, "little") for x in ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        known = self.known
        if len(known) > CACHE:
            known.clear()
        if len(self.weights) > CACHE:
            self.weights.clear()
        cuts = self.cuts.findall(self.normalise(text))
        for cut in set(cuts).difference(known):
            known[cut] = self.shortest_path(cut)
        return b"".join(map(known.__getitem__, cuts))

    def forget(self) -> None:
        """Leaves a worker the cuts and weights it learnt first, the frequent ones, at most ``KEPT`` of each."""
        for table in (self.known, self.weights):
            for key in list(islice(table, KEPT, None)):
                del table[key]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def _transducer(model: bytes) -> Transducer:
    return Transducer(model)


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_column(text: Column, path: str) -> Column:
    """array<int> of ids. The model file is read once, on the driver."""
    model = _model(path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        coder = _transducer(model)
        return _lists([coder.encode(t) for t in as_text(texts)])
    return encode(text)


def decode_column(ids: Column, path: str) -> Column:
    model = _model(path)

    @F.arrow_udf(T.StringType())
    def decode(lists: pa.Array) -> pa.Array:
        coder = _transducer(model)
        return pa.array([coder.decode(x or []) for x in lists.to_pylist()], pa.string())
    return decode(ids)


def _lists(encoded: list[bytes]) -> pa.ListArray:
    flat = np.frombuffer(b"".join(encoded), "<i4")
    return pa.ListArray.from_arrays(pa.array(offsets_of([len(x) // 4 for x in encoded]).astype(np.int32)), pa.array(flat))


def op2(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, n_byte_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256 (of what decoding the ids
    gives back) and ids."""
    model = _model(path)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _transducer(model)
        is_byte = np.zeros(len(coder.pieces), dtype=np.int64)
        is_byte[list(coder.byte_ids.values())] = 1
        for batch in batches_of(batches, 512):
            encoded = [coder.encode(t) for t in as_text(batch.column(1))]
            ids = [np.frombuffer(x, "<u4") for x in encoded]
            decoded = [hashlib.sha256(coder.decode(x.tolist()).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                 pa.array([zlib.crc32(x) for x in encoded], pa.int64()), pa.array(decoded, pa.string()), _lists(encoded)],
                ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "decoded_sha256", "ids"])
        coder.forget()  # what a worker holds between tasks is bounded

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        code, "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string, ids array<int>")
