"""Language identification by interpolated Kneser-Ney character models.

One model per language predicts each character of a word (and its end) from the two before it. A sequence of three
code points is one 63-bit number, so every script keeps all its letters. The models hold the distinct sequences of the
training documents: they grow with the scripts and languages of the corpus, not with its rows. They are stored as one
sorted array of sequence codes with the log-probabilities of all languages beside it; a code that no language has seen
is worked out from the lower orders.

A document goes to the language with the lowest cross-entropy per character (ties: the first by name). The score is the
posterior probability of that language under a temperature fitted on the training documents. ``rejected`` marks
documents whose cross-entropy lies above what 99.9 % of the language's training documents reach; the prediction stays.

Words are runs of letters, and their log-probabilities do not depend on what surrounds them, so each distinct word is
scored once per worker. Null texts and texts without a letter are ``und`` with score 0. Repeated rows are scored each on
its own. Without a training document everything is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skydelay.llm.common import as_text, batches_of, fold, offsets_of, segment_sums
from skydelay.session import cut_lineage

BITS = 21               # of a code point; 0, which no word holds, is the word boundary
KNOWN_WORDS = 300_000  # distinct words a Python worker remembers
KEEP_SHARE = 0.999     # of a language's training documents that its rejection limit lets pass
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code of every three-character sequence that ends at a character of a word or at its end, and the words' offsets."""
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    flat = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    points = flat.astype(np.int64)
    ends = np.cumsum(n)
    place = np.arange(len(points)) - np.repeat(ends - n, n)
    one = np.where(place >= 1, np.concatenate([[0], points[:-1]]), 0)
    two = np.where(place >= 2, np.concatenate([[0, 0], points[:-2]])[:len(points)], 0)
    return (two << 2 * BITS) + (one << BITS) + points, offsets_of(n)


class _Index(dict):
    """Numbers new words in the order they come."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _numbered(texts: list[str], index: _Index) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts as numbers, and the texts' offsets. Texts without a letter have no word."""
    words = [_WORDS.findall(t.lower()) for t in texts]
    words = [w if any(map(str.isalpha, w)) else [] for w in words]
    flat = [i for w in words for i in map(index.__getitem__, w)]
    return np.array(flat, dtype=np.int64), offsets_of([len(w) for w in words])


def sequence_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n) summed over documents (text, lang)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, times = _Index(), {}

        def flush() -> Iterator[pa.RecordBatch]:
            codes, offsets = codes_of(list(index))
            kinds, inverse = np.unique(codes, return_inverse=True)
            for lang, n in times.items():
                own = np.zeros(len(offsets) - 1)
                own[:len(n)] = n
                totals = np.bincount(inverse, np.repeat(own, np.diff(offsets)), len(kinds))
                seen = np.flatnonzero(totals)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(kinds[seen]),
                                                  pa.array(totals[seen].astype(np.int64))], ["lang", "code", "n"])
            index.clear()
            times.clear()

        for batch in batches_of(batches, 256):
            numbers, offsets = _numbered(as_text(batch.column(0)), index)
            langs = np.array(batch.column(1).to_pylist())
            owner = np.repeat(langs, np.diff(offsets))
            for lang in set(langs.tolist()):
                n = np.bincount(numbers[owner == lang], minlength=len(index)).astype(np.float64)
                old = times.get(lang)
                if old is not None:
                    n[:len(old)] += old
                times[lang] = n
            if len(index) > KNOWN_WORDS:
                yield from flush()
        if index:
            yield from flush()

    return docs.select("text", "lang").mapInArrow(count, "lang string, code long, n long") \
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _discount(n: np.ndarray) -> float:
    once, twice = (n == 1).sum(), (n == 2).sum()
    return float(once / (once + 2 * twice)) if once else 0.5


class KneserNey:
    """Interpolated Kneser-Ney of order 3 over the codes of one language: three elements of ``classes`` possible values each,
    of which ``kinds`` (all unless told otherwise) share what the lowest order leaves over."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, classes: int = 64, kinds: int | None = None) -> None:
        self.classes, self.kinds = classes, kinds or classes
        self.tables = []  # order 3, 2, 1: sorted codes, counts less discount, contexts, their totals and left-over mass
        for order in (3, 2, 1):
            size = classes ** (order - 1)
            d = _discount(counts)
            contexts, inverse = np.unique(codes // classes, return_inverse=True)
            total = np.bincount(inverse, counts)
            mass = d * np.bincount(inverse) / total
            self.tables.append((codes, np.maximum(counts - d, 0) / total[inverse], contexts, mass))
            codes, counts = np.unique(codes % size, return_counts=True)  # in how many contexts the shorter one occurs

    def log10(self, codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), 1 / self.kinds)
        for order, (seen, share, contexts, mass) in zip((1, 2, 3), reversed(self.tables)):
            c = codes % self.classes ** order if order < 3 else codes
            at = np.searchsorted(seen, c).clip(max=len(seen) - 1)
            own = np.where(seen[at] == c, share[at], 0.0)
            context = c // self.classes
            at = np.searchsorted(contexts, context).clip(max=len(contexts) - 1)
            known = contexts[at] == context
            p = own + np.where(known, mass[at], 1.0) * p
        return np.log10(p)


class Scorer:
    """Log-probabilities under all languages: a sorted array of codes with a row per code. ``counts``: (lang, code, n)."""

    def __init__(self, counts: pa.Table) -> None:
        langs = counts["lang"].combine_chunks().dictionary_encode()
        names, owner = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        codes, n = counts["code"].to_numpy(), counts["n"].to_numpy().astype(np.float64)
        self.langs = sorted(names)
        self.codes = np.unique(codes)
        kinds = len(np.unique(self.codes % (1 << BITS))) + 1  # the characters seen, and all others as one
        self.models = []
        for lang in self.langs:
            own = np.flatnonzero(owner == names.index(lang))
            own = own[np.argsort(codes[own])]
            self.models.append(KneserNey(codes[own], n[own], 1 << BITS, kinds))
        self.values = self._compute(self.codes)

    def _compute(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([m.log10(codes) for m in self.models], axis=1) if len(codes) else np.zeros((0, len(self.models)))

    def words(self, words: list[str]) -> np.ndarray:
        """Row per word: log10 probability under each language, and the number of characters it predicts."""
        codes, offsets = codes_of(words)
        kinds, inverse = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.codes, kinds).clip(max=len(self.codes) - 1)
        values = self.values[at]
        new = self.codes[at] != kinds
        values[new] = self._compute(kinds[new])
        return np.column_stack([segment_sums(values[inverse], offsets), np.diff(offsets)])


def entropies(docs: DataFrame, scorer: Scorer, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``bits``: cross-entropy per character under each language (empty where there is no letter), and ``chars``."""
    from pyspark.sql import types as T
    width = len(scorer.langs)
    kind = T.StructType([T.StructField("bits", T.ArrayType(T.DoubleType())), T.StructField("chars", T.LongType())])
    memory: dict[str, object] = {}

    @F.arrow_udf(kind)
    def measure(texts: pa.Array) -> pa.Array:
        if "index" not in memory or len(memory["index"]) > KNOWN_WORDS:
            memory["index"], memory["rows"] = _Index(), np.zeros((KNOWN_WORDS // 4, width + 1))
        index = memory["index"]
        parts = [np.zeros((0, width + 1))]
        for at in range(0, len(texts), 256):
            before = len(index)
            numbers, offsets = _numbered(as_text(texts.slice(at, 256)), index)
            if len(index) > before:
                if len(index) > len(memory["rows"]):
                    memory["rows"] = np.concatenate([memory["rows"], np.zeros((len(index), width + 1))])
                memory["rows"][before:len(index)] = scorer.words(list(islice(index, before, None)))
            parts.append(segment_sums(memory["rows"][numbers], offsets))
        sums = np.concatenate(parts)
        chars = sums[:, -1].astype(np.int64)
        some = chars > 0
        bits = -sums[some, :-1] / sums[some, -1:] / np.log10(2)
        lists = pa.ListArray.from_arrays(pa.array(offsets_of(some * width).astype(np.int32)), pa.array(bits.ravel()))
        return pa.StructArray.from_arrays([lists, pa.array(chars)], ["bits", "chars"])

    return docs.select("doc_id", "lang", *keep, measure("text").alias("m")).select("doc_id", "lang", *keep, "m.bits", "m.chars")


def identify(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected and the ``keep`` columns, one row per input row."""
    held = fold(F.col("doc_id"), 3) == 1
    learn = ~held & F.col("lang").isNotNull()
    counts = cut_lineage(sequence_counts(docs.where(learn & F.col("text").isNotNull())))
    found = counts.toArrow()  # a row for each distinct sequence of each language, whatever the number of documents
    if not len(found):
        return docs.select("doc_id", held.alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(False).alias("rejected"), *keep)
    scorer = Scorer(found)
    names = F.array(*map(F.lit, scorer.langs))
    measured = cut_lineage(entropies(docs, scorer, keep))
    best = F.array_min("bits")
    place = F.array_position("bits", best) - 1
    # temperature: the posterior is exp(-evidence) with evidence = gap in bits * chars^0.5 * t; t makes the mean
    # posterior of the training documents equal to their accuracy, looked up on a grid
    gaps = F.transform("bits", lambda x: (x - best) * F.sqrt(F.col("chars")))
    own = measured.where(learn & (F.col("chars") > 0)).select(
        "lang", best.alias("low"), (F.get(names, place.cast("int")) == F.col("lang")).cast("double").alias("right"), gaps.alias("gaps"))
    grid = [0.125 * 2 ** k for k in range(8)]

    def posterior(g, t):
        return 1 / F.aggregate(g, F.lit(0.0), lambda a, x: a + F.exp(-x * F.lit(float(t))))

    row = own.agg(F.avg("right").alias("right"), *[F.avg(posterior(F.col("gaps"), t)).alias(f"t{i}") for i, t in enumerate(grid)]).first()
    chosen = min(range(len(grid)), key=lambda i: abs((row[f"t{i}"] or 0) - (row["right"] or 0)))
    limits = {r["lang"]: r["limit"] for r in own.where("right = 1").groupBy("lang").agg(
        F.percentile_approx("low", KEEP_SHARE, 10_000).alias("limit")).collect()}  # a row per language
    limit = F.array(*[F.lit(float(limits.get(k, float("inf")))) for k in scorer.langs])
    some = F.col("chars") > 0
    return measured.select(
        "doc_id", held.alias("held_out"), F.when(some, F.get(names, place.cast("int"))).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(some, posterior(gaps, grid[chosen])).otherwise(F.lit(0.0)).alias("score"),
        F.coalesce(some & (best > F.get(limit, place.cast("int"))), F.lit(False)).alias("rejected"), *keep)


def op7(docs: DataFrame) -> DataFrame:
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")
