"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

* Statistics: about thirty numbers per text (shares of character classes, word and line lengths, repetition), computed in
  one narrow pass; only these are kept, so the texts are read once.
* Kernel: after robust scaling, cos(W x + b) with Gaussian W approximates a Gaussian kernel.
* Fit: every task sums its rows' part of Z'Z and Z'y (D x D numbers, whatever its rows); the parts are added in Spark and
  the ridge system of D unknowns is solved on the driver. All labelled training rows are used.
* Calibration: raw scores of the training rows are counted in a fixed grid, and pool-adjacent-violators over the grid
  gives a monotone step function to probabilities.

Nulls and empty texts have the statistics of a text without words. Labels: several rows of an id are averaged, null
labels are ignored. Without a usable training row of both classes the score is the share of good labels (0.5 if none).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skydelay.llm.common import as_bytes, fold
from skydelay.session import cut_lineage

FEATURES = 192        # random Fourier features
BANDWIDTH = 6.0       # of the Gaussian kernel, in units of scaled statistics
RIDGE = 1e-3          # per training row
GRID = 2048           # cells of the calibration histogram
THRESHOLD = 0.3       # predicted = 1 from this score on

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c",
            b".", b",", b"!", b"?", b"#*$%&|<>", b"\"'`", b"()[]{}", b"@/\\_=+-~^", b":;"]
_CLASS_OF_BYTE = np.full(256, len(_CLASSES), dtype=np.int64)  # the last class: bytes of characters outside ASCII
for _k, _members in enumerate(_CLASSES):
    _CLASS_OF_BYTE[list(_members)] = _k
_N_CLASSES = len(_CLASSES) + 1
N_STATS = _N_CLASSES + 12


def statistics(text: bytes) -> list[float]:
    """The statistics of a UTF-8 text."""
    n = max(1, len(text))
    classes = np.bincount(_CLASS_OF_BYTE, np.bincount(np.frombuffer(text, np.uint8), minlength=256), _N_CLASSES)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    m, k = max(1, len(words)), max(1, len(lines))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    top = [*nlargest(2, counts.values()), 0, 0]
    unique_lines = len(set(lines))
    return [*np.sqrt(classes / n), np.log1p(len(words)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
            len(counts) / m, len(counts) / m ** 0.8, top[0] / m, top[1] / m, sum(map(eq, words, words[1:])) / m,
            np.log1p(k), 1 - unique_lines / k, np.log1p(n / k)]


def statistics_column(text: Column) -> Column:
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def compute(texts: pa.Array) -> pa.Array:
        values = np.array([statistics(t) for t in as_bytes(texts)], dtype=np.float32).reshape(-1, N_STATS)
        return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), N_STATS).cast(pa.list_(pa.float32()))
    return compute(text)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, N_STATS)


@dataclass(frozen=True)
class QualityModel:
    center: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray      # calibrated probability of each cell of the grid

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.center) / self.scale, -8, 8) @ self.directions + self.phases
        return np.concatenate([np.cos(z) * np.sqrt(2 / z.shape[1]), np.ones((len(z), 1))], axis=1)

    def cells(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights
        return np.clip(((raw + 0.5) / 2 * GRID).astype(np.int64), 0, GRID - 1)

    def score_column(self, stats: Column) -> Column:
        model = self

        @F.arrow_udf(T.DoubleType())
        def compute(column: pa.Array) -> pa.Array:
            return pa.array(model.steps[model.cells(_matrix(column))])
        return compute(stats)


def isotonic(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing share of ``good`` per cell; cells without rows are interpolated."""
    used = np.flatnonzero(total)
    blocks: list[list[float]] = []  # good, total, cells
    for g, n in zip(good[used], total[used]):
        blocks.append([g, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    # half a row of each class keeps small blocks off 0 and 1; taking running maxima keeps the order
    shares = np.maximum.accumulate(np.repeat([(g + 0.5) / (n + 1) for g, n, _ in blocks], [int(k) for *_, k in blocks]))
    return np.interp(np.arange(len(total)), used, shares)


def fit(train: DataFrame, seed: int = 7, features: int = FEATURES) -> QualityModel:
    """Fit on rows of (stats array<float>, label double). ``train`` is read three times: pass a written table."""
    # ranges of the statistics: one row
    s = [F.col("stats")[i] for i in range(N_STATS)]
    row = train.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share"),
                    *[F.avg(x).alias(f"m{i}") for i, x in enumerate(s)],
                    *[F.stddev_pop(x).alias(f"d{i}") for i, x in enumerate(s)]).first()
    rng = np.random.default_rng(seed)
    center = np.array([row[f"m{i}"] or 0.0 for i in range(N_STATS)])
    scale = np.array([row[f"d{i}"] or 0.0 for i in range(N_STATS)])
    model = QualityModel(center, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(N_STATS, features)) / BANDWIDTH,
                         rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.full(GRID, row["share"] or 0.5))
    if not row["n"] or row["share"] in (0.0, 1.0):
        return model
    d = features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            z = model.features(_matrix(batch.column(0)))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * (d + 1), dtype=np.int32)), pa.array(total.ravel())],
                                         ["cell", "value"])

    parts = train.select("stats", "label").mapInArrow(sums, "cell int, value double")
    cells = parts.groupBy("cell").agg(F.sum("value").alias("value")).toPandas()  # D x (D + 1) numbers
    system = np.zeros(d * (d + 1))
    system[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    system = system.reshape(d, d + 1)
    penalty = np.eye(d) * RIDGE * row["n"] / d
    penalty[-1, -1] = 0  # the intercept is free
    weights = np.linalg.solve(system[:, :d] + penalty + np.eye(d) * 1e-9, system[:, d])
    raw = QualityModel(model.center, model.scale, model.directions, model.phases, weights, model.steps)

    @F.arrow_udf(T.IntegerType())
    def cell_of(stats: pa.Array) -> pa.Array:
        return pa.array(raw.cells(_matrix(stats)).astype(np.int32))

    grid = train.select(cell_of("stats").alias("cell"), "label").groupBy("cell") \
        .agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("total")).toPandas()  # at most GRID rows
    good, total = np.zeros(GRID), np.zeros(GRID)
    good[grid["cell"].to_numpy()] = grid["good"].to_numpy()
    total[grid["cell"].to_numpy()] = grid["total"].to_numpy()
    return QualityModel(model.center, model.scale, model.directions, model.phases, weights, isotonic(good, total))


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(stats, label) of the labelled rows whose id folds to 1-4 of 5. ``stats``: doc_id, stats."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id") \
        .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    return stats.where(fold(F.col("doc_id"), 5) != 0).join(known, "doc_id").select("stats", "label")


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the ``keep`` columns, one row per input row."""
    stats = cut_lineage(docs.select("doc_id", *keep, statistics_column(F.col("text")).alias("stats")))
    model = fit(cut_lineage(training_rows(stats, labels)))
    scored = stats.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
                          model.score_column(F.col("stats")).alias("score"), *keep)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels).select("doc_id", "held_out", "score", "predicted")
