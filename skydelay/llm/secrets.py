"""Secret scans: fixed patterns plus a character convolutional network over every other candidate.

* Patterns (assign, access, hex) find the base spans of every text.
* Candidates are all runs of 8 or more key characters, and what base spans leave of such runs. Each is seen as
  windows of characters: a piece of the run and the context before and after it. Pieces of a long run overlap by half;
  the run's score is the highest of its pieces.
* The network (character embedding, one convolution, max pooling, two dense layers, in numpy) is trained on findings
  labelled by the patterns: base spans are positives, the other candidates (mail addresses, numbers, dotted
  addresses, versions, ...) are negatives. Half of the time a finding is shown without its context or with that of
  another, so the network learns the look of a secret and not only the keyword before it. The sample is bounded by ``SAMPLE`` findings of each label
  with the smallest hash of (text, place), spread over all documents.
* Threshold: every fifth finding by hash is kept out of training. All of these, with their context and without it, are
  scored where they lie and summed into a histogram of logits per label. Logits are calibrated on it (Platt scaling), and
  the threshold is the highest that recalls ``RECALL`` of the kept-out positives, or halfway to the negatives where 99.99 %
  of them end below that point. A candidate scoring at least that much is added as a span of kind ``model``. If a table is
  so small that one label has no finding in either part, all findings serve for both.
* Speed: a slice of texts becomes one array of character codes. Runs are found on it, and the convolution adds up rows of
  tables (embedding times filter) by the codes of neighbouring characters, so no per-character Python is left.

Nulls and empty texts have no span. Repeated rows are scanned each on its own. With no labelled finding of one kind the
network adds nothing. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skydelay.llm.common import as_text, batches_of, offsets_of
from skydelay.session import cut_lineage

KINDS = ("assign", "access", "hex", "model")
SAMPLE = 3000            # findings of each label that the network is fitted on
RECALL = 0.95
CLEAR = 0.9999           # of the kept-out negatives
EPOCHS = 40              # most rounds of training
KEPT_OUT = 5             # every so many findings set the threshold and are not trained on
BEFORE, PIECE, AFTER = 16, 40, 16  # characters of context, of the candidate and of context that the network sees at once
INSIDE = PIECE + AFTER
FILTERS, WIDTH, HIDDEN, EMBED = 24, 5, 16, 8
CODES = 98               # character codes: 0 nothing, 1-95 printable ASCII, 96 white space, 97 other
BIN, BINS = 1 / 64, 5120  # histogram of logits from -40 to 40
SLICE = 1 << 20          # characters laid out at once (a longer text alone)

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_HINT = re.compile(r"[:=]", re.A)
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern findings, sorted."""
    found = []
    if _HINT.search(text):
        low = text.lower() if text.isascii() else text.translate(_LOWER)
        if "password" in low or "passwd" in low or "secret" in low or "token" in low or "key" in low:
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


_LOWER = {c: c + 32 for c in range(65, 91)}


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the runs of 8 or more key characters, without what the base spans (sorted) hold of them."""
    if not taken:
        return [m.span() for m in _RUN.finditer(text)]
    out, at = [], 0
    for start, _, end in [*taken, (len(text), 0, len(text))]:
        out += [m.span() for m in _RUN.finditer(text, at, max(at, start))]
        at = max(at, end)
    return out


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """A run in pieces that overlap by half, so every character is in one."""
    starts = [*range(start, max(start + 1, end - PIECE), PIECE // 2), *([end - PIECE] if end - start > PIECE else [])]
    return [(a, min(end, a + PIECE)) for a in starts]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Code of every code point, and which codes are key characters."""
    code = np.full(0x110000, 97, dtype=np.uint8)
    code[33:127] = np.arange(33, 127) - 31
    code[[c for c in range(0x10000) if chr(c).isspace()]] = 96
    key = np.zeros(CODES, dtype=bool)
    key[[code[ord(c)] for c in "+/_.=-" + "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))]] = True
    return code, key


_CODE_OF, _IS_KEY = _tables()
_GAP = max(BEFORE, AFTER)


def lay_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts in one array with nothing (0) before, between and after them, and each text's begin."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = offsets_of(n + _GAP) + _GAP
    gap = "\0" * _GAP
    flat = np.frombuffer((gap + gap.join([*texts, ""])).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _CODE_OF[flat]
    codes[(begins[:, None] - np.arange(1, _GAP + 1)).ravel()] = 0
    return codes, begins[:-1]


def runs_in(codes: np.ndarray, taken: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of 8 or more key characters outside the ``taken`` places: ``candidates`` of all texts."""
    key = _IS_KEY[codes]
    for a, b in taken:
        key[a:b] = False
    edge = np.flatnonzero(key[1:] != key[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    some = ends - starts >= 8
    return starts[some], ends[some]


def pieces_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``pieces`` of all runs, one after another, and the offsets of each run's."""
    n = 1 + np.maximum(0, -(-(ends - starts - PIECE) // (PIECE // 2)))
    offsets = offsets_of(n)
    run = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(run)) - offsets[run]
    a = np.where((k > 0) & (k == n[run] - 1), ends[run] - PIECE, starts[run] + k * (PIECE // 2))
    return a, np.minimum(ends[run], a + PIECE), offsets


def gather(codes: np.ndarray, a: np.ndarray, b: np.ndarray, inside: int = PIECE) -> np.ndarray:
    """A row per piece: the context before it, the piece (filled up with nothing to ``inside``), the context after it."""
    out = np.zeros((len(a), BEFORE + inside + AFTER), dtype=np.uint8)
    at = a[:, None] + np.arange(inside)
    own = at < b[:, None]
    out[:, :BEFORE] = codes[a[:, None] + np.arange(-BEFORE, 0)]
    out[:, BEFORE:BEFORE + inside] = np.where(own, codes[np.where(own, at, 0)], 0)
    out[:, BEFORE + inside:] = codes[b[:, None] + np.arange(AFTER)]
    return out


def windows(found: list[tuple[str, int, int]]) -> np.ndarray:
    """Rows of (text, start, end): at most ``PIECE`` characters from the start on, and the context on either side."""
    codes, begins = lay_out([t for t, _, _ in found])
    a = begins + np.array([a for _, a, _ in found], dtype=np.int64)
    return gather(codes, a, np.minimum(begins + np.array([b for _, _, b in found], dtype=np.int64), a + PIECE))


def slices(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of at most ``SLICE`` characters together."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > SLICE:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t) + _GAP
    if part:
        yield part


@dataclass
class Network:
    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0          # of the calibrated probability
    cut: float = float("inf")       # the same of the logit
    recall: float = 0.0             # of the findings that set the threshold

    @classmethod
    def fresh(cls, seed: int = 5) -> "Network":
        rng = np.random.default_rng(seed)
        return cls(rng.normal(size=(CODES, EMBED)) * 0.5, rng.normal(size=(WIDTH * EMBED, FILTERS)) * 0.2, np.zeros(FILTERS),
                   rng.normal(size=(3 * FILTERS, HIDDEN)) * 0.2, np.zeros(HIDDEN), rng.normal(size=HIDDEN) * 0.2, np.zeros(1))

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.embed[codes]                                           # n, length, embed
        n, length, _ = x.shape
        cut = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)  # n, length - width + 1, embed, width
        cut = cut.transpose(0, 1, 3, 2).reshape(n, length - WIDTH + 1, WIDTH * EMBED)
        z = np.maximum(cut @ self.conv + self.conv_bias, 0)
        one, two = BEFORE - WIDTH + 1, BEFORE + PIECE                   # windows wholly in the context: [:one], [two:]
        top = np.concatenate([z[:, :one].argmax(1), z[:, one:two].argmax(1) + one, z[:, two:].argmax(1) + two], axis=1)
        pooled = np.take_along_axis(z, top.reshape(n, 3, FILTERS), axis=1).reshape(n, 3 * FILTERS)
        hidden = np.maximum(pooled @ self.dense + self.dense_bias, 0)
        return hidden @ self.out + self.out_bias[0], (codes, cut, top, pooled, hidden)

    def gradients(self, state: tuple, error: np.ndarray) -> list[np.ndarray]:
        codes, cut, top, pooled, hidden = state
        n = len(error)
        d_hidden = np.outer(error, self.out) * (hidden > 0)
        d_pooled = (d_hidden @ self.dense.T) * (pooled > 0)
        flat_top = top.reshape(n, 3, FILTERS)
        rows = np.arange(n)[:, None, None]
        picked = cut[rows, flat_top]                                    # n, 3, filters, width * embed
        weight = d_pooled.reshape(n, 3, FILTERS)
        d_conv = np.einsum("nkfw,nkf->wf", picked, weight)
        d_cut = np.einsum("nkf,wf->nkfw", weight, self.conv).reshape(n, 3, FILTERS, WIDTH, EMBED)
        d_embed = np.zeros_like(self.embed)
        at = flat_top[..., None] + np.arange(WIDTH)
        np.add.at(d_embed, codes[rows[..., None], at], d_cut)
        return [d_embed, d_conv, weight.sum((0, 1)), pooled.T @ d_hidden, d_hidden.sum(0), hidden.T @ error,
                np.array([error.sum()])]

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_bias, self.dense, self.dense_bias, self.out, self.out_bias]

    def lookups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The convolution as tables: by the codes of two characters, of the next two, and of the fifth."""
        one = np.stack([self.embed @ self.conv[w * EMBED:(w + 1) * EMBED] for w in range(WIDTH)]).astype(np.float32)
        pairs = [(one[w][:, None] + one[w + 1]).reshape(CODES ** 2, FILTERS) for w in (0, 2)]
        return *pairs, one[4] + self.conv_bias.astype(np.float32)

    def _logits(self, rows: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Logits of rows of any inner width; the convolution is rectified after pooling, which is the same."""
        pairs = rows[:, :-1].astype(np.int32) * CODES + rows[:, 1:]
        z = tables[0].take(pairs[:, :-3], axis=0)
        z += tables[1].take(pairs[:, 2:-1], axis=0)
        z += tables[2].take(rows[:, 4:], axis=0)
        one, two = BEFORE - WIDTH + 1, rows.shape[1] - AFTER
        pooled = np.concatenate([z[:, :one].max(1), z[:, one:two].max(1), z[:, two:].max(1)], axis=1)
        hidden = np.maximum(np.maximum(pooled, 0) @ self.dense + self.dense_bias, 0)
        return hidden @ self.out + self.out_bias[0]

    def logits_at(self, codes: np.ndarray, a: np.ndarray, b: np.ndarray, bare: bool = False) -> np.ndarray:
        """Logits of the pieces [a, b) of laid out texts, without their context if ``bare``. Pieces are taken by length:
        ``WIDTH`` times nothing after the longest of a chunk gives the same highest values as filling up to ``PIECE``."""
        tables, out = self.lookups(), np.zeros(len(a))
        order = np.argsort(b - a, kind="stable")
        for i in range(0, len(order), 512):
            rows = order[i:i + 512]
            inside = min(PIECE, int(b[rows[-1]] - a[rows[-1]]) + WIDTH)
            x = gather(codes, a[rows], b[rows], inside)
            if bare:
                x[:, :BEFORE] = x[:, BEFORE + inside:] = 0
            out[rows] = self._logits(x, tables)
        return out

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of rows of ``windows``."""
        if not len(codes):
            return np.zeros(0)
        tables = self.lookups()
        logits = np.concatenate([self._logits(codes[i:i + 512], tables) for i in range(0, len(codes), 512)])
        return _logistic(self.slope * logits + self.shift)

    def calibrate(self, counts: np.ndarray) -> None:
        """Platt scaling and threshold from a histogram of logits (labels 0 and 1, ``BINS``)."""
        middle = (np.arange(BINS) + 0.5) * BIN - BINS * BIN / 2
        total, good = counts.sum(0) / counts.sum(), counts[1] / counts.sum()
        a, b = 1.0, 0.0
        for _ in range(100):  # Newton's method; the slope is held near 1 where the labels are apart
            p = _logistic(a * middle + b)
            w = total * p * (1 - p)
            grad = np.array([((total * p - good) * middle).sum() + 0.01 * (a - 1), (total * p - good).sum() + 1e-6 * b])
            cross = (w * middle).sum()
            step = np.linalg.solve([[(w * middle ** 2).sum() + 0.01, cross], [cross, w.sum() + 1e-6]], grad)
            step *= min(1.0, 1 / max(1e-12, np.abs(step).max()))
            a, b = max(1e-3, a - step[0]), b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(a), float(b)
        # the highest edge of a bin with RECALL of the positives at or above it
        above = counts[1][::-1].cumsum()[::-1]
        top = np.flatnonzero(above >= RECALL * counts[1].sum())[-1]
        below = counts[0].cumsum()
        clear = np.searchsorted(below, CLEAR * below[-1]) + 1
        at = (top + clear) // 2 if clear < top else top
        self.recall = float(above[at] / counts[1].sum())
        self.cut = float(at * BIN - BINS * BIN / 2)
        self.threshold = float(_logistic(self.slope * self.cut + self.shift))


def _logistic(x: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def train(codes: np.ndarray, labels: np.ndarray, steps: int = 800, batch: int = 64, rate: float = 0.004) -> Network:
    """Adam on the logistic loss; both labels weigh the same. Few findings are not learnt by heart: no more than ``EPOCHS``
    rounds, as an unlabelled secret among the negatives would be."""
    net = Network.fresh()
    steps = min(steps, -(-EPOCHS * len(labels) // batch))
    labels = labels.astype(np.float64)
    weight = np.where(labels > 0, len(labels) / max(1, labels.sum()), len(labels) / max(1, (1 - labels).sum())) / 2
    rng = np.random.default_rng(9)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(-(-steps * batch // len(labels))):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), batch):
            rows = order[i:i + batch]
            x = codes[rows].copy()
            shown = rng.random(len(x))
            bare, other = shown < 0.25, (shown >= 0.25) & (shown < 0.5)
            x[bare, :BEFORE] = x[bare, BEFORE + PIECE:] = 0
            lent = codes[rng.integers(0, len(codes), int(other.sum()))]
            x[other, :BEFORE], x[other, BEFORE + PIECE:] = lent[:, :BEFORE], lent[:, BEFORE + PIECE:]
            logits, state = net.forward(x)
            error = (_logistic(logits) - labels[rows]) * weight[rows] / len(rows)
            step += 1
            for p, g, (m, v) in zip(net.parameters(), net.gradients(state, error), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            if step == steps:
                return net
    return net


def _findings(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the texts laid out, and of every labelled piece its label (1: of a base span, 0: of another candidate),
    its rank (a hash of text and place, so copies agree), start and end."""
    codes, begins = lay_out(texts)
    taken, good = [], []
    for t, begin in zip(texts, begins.tolist()):
        base = base_spans(t)
        taken += [(begin + a, begin + b) for a, _, b in base]
        if any(kind == 0 for _, kind, _ in base):
            good += [(begin + m.start(2), begin + m.end(2)) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
        good += [(begin + a, begin + b) for a, kind, b in base if kind]
    ones = np.array(good, dtype=np.int64).reshape(-1, 2)
    zeros = runs_in(codes, taken)
    a, b, offsets = pieces_of(np.concatenate([ones[:, 0], zeros[0]]), np.concatenate([ones[:, 1], zeros[1]]))
    label = np.repeat(np.arange(len(offsets) - 1) < len(ones), np.diff(offsets)).astype(np.int32)
    seeds = np.array([int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "big")
                      for t in texts], dtype=np.uint64)
    text = np.searchsorted(begins, a, side="right") - 1
    x = seeds[text] + (a - begins[text]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift in (32, 29):  # spreads the bits
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return codes, label, (x >> np.uint64(8)).astype(np.int64), a, b


def labelled_findings(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(label, kept_out, rank, codes) of findings: in each task those of the ``sample`` smallest ranks of either label
    and part, so a task hands over no more than that."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {(k, out): (np.zeros(0, np.int64), np.zeros((0, BEFORE + INSIDE), np.uint8)) for k in (0, 1) for out in (False, True)}
        for batch in batches_of(batches, 500):
            for texts in slices(as_text(batch.column(0))):
                codes, label, rank, a, b = _findings(texts)
                for (k, out), (ranks, rows) in best.items():
                    limit = ranks[-1] if len(ranks) == sample else np.iinfo(np.int64).max
                    new = np.flatnonzero((label == k) & ((rank % KEPT_OUT == 0) == out) & (rank < limit))
                    _, first = np.unique(rank[new], return_index=True)  # in order of rank
                    new = new[first[:sample]]
                    ranks, at = np.unique(np.concatenate([ranks, rank[new]]), return_index=True)
                    best[k, out] = ranks[:sample], np.concatenate([rows, gather(codes, a[new], b[new])])[at[:sample]]
        for (k, out), (ranks, rows) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(ranks), pa.int32()), pa.array([out] * len(ranks), pa.bool_()),
                                              pa.array(ranks), pa.array([r.tobytes() for r in rows], pa.binary())],
                                             ["label", "kept_out", "rank", "codes"])

    return docs.select("text").mapInArrow(find, "label int, kept_out boolean, rank long, codes binary")


def logit_histogram(docs: DataFrame, net: Network, kept_out_only: bool = True) -> np.ndarray:
    """How many findings of either label have a logit of each bin, seen with their context and without it."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * BINS, dtype=np.int64)
        for batch in batches_of(batches, 500):
            for texts in slices(as_text(batch.column(0))):
                codes, label, rank, a, b = _findings(texts)
                if kept_out_only:
                    label, a, b = (x[rank % KEPT_OUT == 0] for x in (label, a, b))
                for bare in (False, True):
                    place = np.floor(net.logits_at(codes, a, b, bare) / BIN + BINS / 2).clip(0, BINS - 1).astype(np.int64)
                    counts += np.bincount(label * BINS + place, minlength=2 * BINS)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["cell", "n"])

    out = np.zeros(2 * BINS)
    for cell, n in docs.select("text").mapInArrow(measure, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():  # 2 BINS
        out[cell] = n
    return out.reshape(2, BINS)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network:
    found = cut_lineage(labelled_findings(docs, sample))
    parts = {(k, out): found.where((F.col("label") == k) & (F.col("kept_out") == out)).dropDuplicates(["codes"])
             .orderBy("rank", "codes").limit(sample).select("rank", "label", "codes").collect()  # sample rows at most
             for k in (0, 1) for out in (False, True)}
    apart = all(parts.values())
    rows = [r for (_, out), part in parts.items() if not (out and apart) for r in part]
    if len({r["label"] for r in rows}) < 2:
        return Network.fresh()  # no finding of one label in all documents: adds nothing
    rows.sort(key=lambda r: (r["rank"], bytes(r["codes"])))
    codes = np.frombuffer(b"".join(bytes(r["codes"]) for r in rows), np.uint8).reshape(-1, BEFORE + INSIDE)
    net = train(codes, np.array([r["label"] for r in rows], dtype=np.int64))
    net.calibrate(logit_histogram(docs, net, kept_out_only=apart))
    return net


def spans_column(text: Column, net: Network) -> Column:
    """array<struct<kind int, start int, end int>> by start, then kind."""
    item = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()),
                         T.StructField("end", T.IntegerType())])

    @F.arrow_udf(T.ArrayType(item))
    def scan(texts: pa.Array) -> pa.Array:
        columns, lengths = [], []
        for part in slices(as_text(texts)):
            codes, begins = lay_out(part)
            base = [(i, a, k, b) for i, t in enumerate(part) for a, k, b in base_spans(t)]
            place = np.array(base, dtype=np.int64).reshape(-1, 4)
            starts, ends = runs_in(codes, [(begins[i] + a, begins[i] + b) for i, a, _, b in base])
            a, b, offsets = pieces_of(starts, ends)
            if len(starts) and np.isfinite(net.cut):
                top = np.maximum.reduceat(net.logits_at(codes, a, b), offsets[:-1])
                starts, ends = starts[top >= net.cut], ends[top >= net.cut]
                text = np.searchsorted(begins, starts, side="right") - 1
                more = np.column_stack([text, starts - begins[text], np.full(len(text), 3), ends - begins[text]])
                place = np.concatenate([place, more])
                place = place[np.lexsort((place[:, 2], place[:, 1], place[:, 0]))]
            columns.append(place[:, 1:])
            lengths.append(np.bincount(place[:, 0], minlength=len(part)))
        flat = np.concatenate([np.zeros((0, 3), np.int64), *columns]).astype(np.int32)
        offsets = offsets_of(np.concatenate([np.zeros(0, np.int64), *lengths])).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in (1, 0, 2)], ["kind", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(offsets), spans)
    return scan(text)


def redacted_column(text: Column, spans: Column, mask: str = "<secret>") -> Column:
    """The text with every span (overlapping ones merged) replaced by ``mask``; null stays null."""
    @F.arrow_udf(T.StringType())
    def redact(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, spans_ in zip(texts.to_pylist(), found.to_pylist()):
            if t is not None and spans_:
                parts, at = [], 0
                for s in spans_:
                    if s["start"] >= at:
                        parts += [t[at:s["start"]], mask]
                    at = max(at, s["end"])
                t = "".join(parts) + t[at:]
            out.append(t)
        return pa.array(out, pa.string())
    return redact(text, spans)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and its spans."""
    net = fit(docs)
    return docs.select("doc_id", spans_column(F.col("text"), net).alias("spans"))


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    spans = F.col("spans")

    def of_kind(k: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    base = F.filter(spans, lambda s: s["kind"] < 3)
    return cut_lineage(scan(docs)).select("doc_id", of_kind(0), of_kind(1), of_kind(2), F.sha2(span_text(base), 256).alias("base_sha256"),
                                          span_text(spans).alias("spans"), of_kind(3))
