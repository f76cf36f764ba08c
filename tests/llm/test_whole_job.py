"""Cases in which an operator once did less than the whole job."""
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_operators import planted

from skydelay.llm import fingerprints, lm_scoring, quality_rules, secrets


# --- LM scoring

def test_words_outside_the_units_take_their_class_from_their_neighbours(spark):
    """Words of equal ending, seen at two kinds of places: their classes follow the places."""
    rng = random.Random(3)
    first, second = ([f"{k}{i}{k}" for i in range(520)] for k in "ab")
    rare = [[f"{k}{i}same" for i in range(30)] for k in "pq"]
    rows = []
    for i in range(3000):
        words = [w for _ in range(10) for w in (rng.choice(first), rng.choice(second))]
        words[2], words[13] = (rare[0][i % 30], rare[1][i % 30]) if i < 240 else (words[2], words[13])
        rows.append((i, " ".join(words)))
    train = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = Counter(w.encode() for _, t in rows for w in t.split())
    counts[lm_scoring.END] = len(rows)
    head = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    model, _ = lm_scoring._learn(train, lm_scoring.word_counts(train), head, 0.5)
    classes = {w.decode(): c for (w, _), c in zip(model.head, model.head_class)}
    assert not any(w.encode() in dict(head[:lm_scoring.UNIT_WORDS]) for ws in rare for w in ws)
    a, b = ({classes[w] for w in ws} for ws in rare)
    assert not a & b
    assert model.size.sum() == sum(counts.values())


def test_words_beyond_the_head_move_and_scores_are_those_of_the_classes(spark):
    """Class bigrams and scores from the learned classes by plain counting; unseen words and repeated words included."""
    from math import log10
    from zlib import crc32
    rng = random.Random(5)
    first, second = ([f"{k}{i}{k}" for i in range(520)] for k in "ab")
    rare = [[f"{k}{i}same" for i in range(30)] for k in "pq"]
    rows = []
    for i in range(2500):
        words = [w for _ in range(10) for w in (rng.choice(first), rng.choice(second))]
        words[2], words[13] = (rare[0][i % 30], rare[1][i % 30]) if i < 240 else (words[2], words[13])
        words[4:4] = ["p1same", "p1same", "q2same"] if i % 50 == 0 else []
        rows.append((i, " ".join(words) + (f" new{i}" if i % 9 == 0 else "")))
    docs = spark.createDataFrame([*rows, (9000, None)], "doc_id long, text string").repartition(3)
    size = 1030
    held = {i: crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    texts = {i: [w.encode() for w in t.split()] + [lm_scoring.END] for i, t in rows}
    texts[9000], held[9000] = [lm_scoring.END], crc32(b"9000") % 7 == 2
    counts = Counter(w for i, ws in texts.items() if not held[i] for w in ws)
    head = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]
    once, twice = (sum(n == k and w != lm_scoring.END for w, n in counts.items()) for k in (1, 2))
    d = min(once / (once + 2 * twice), 0.99)
    train = docs.where(~F.col("doc_id").isin([i for i in held if held[i]]))
    model, rarer = lm_scoring._learn(train, lm_scoring.word_counts(train), head, d)
    far = {bytes(r["word"]): r["class"] for r in rarer.collect()}
    assert set(far) == set(counts) - {w for w, _ in head}
    a, b = ({far[w.encode()] for w in ws if w.encode() in far} for ws in rare)
    assert a and b and not a & b
    classes = {w: int(c) for (w, _), c in zip(head, model.head_class)} | far
    joint = np.zeros((lm_scoring.CLASSES,) * 2)
    for i, ws in texts.items():
        if not held[i]:
            for x, y in zip([lm_scoring.END, *ws], ws):
                joint[classes[x], classes[y]] += 1
    frequency = (joint.sum(0) + 1) / (joint.sum() + lm_scoring.CLASSES)
    transition = np.log10((joint + lm_scoring.PRIOR * frequency) / (joint.sum(1, keepdims=True) + lm_scoring.PRIOR))
    assert model.transition == pytest.approx(transition)
    kinds = Counter(c for w, c in classes.items() if w != lm_scoring.END)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, size).collect()}
    for i, ws in texts.items():
        total, old = 0.0, 0
        for w in ws:
            c = classes[w] if w in classes else model.class_of(w)
            total += transition[old, c]
            if w in counts and w != lm_scoring.END:
                total += log10((counts[w] - d) / joint.sum(0)[c])
            elif w != lm_scoring.END:
                total += (log10(d * kinds[c]) if kinds[c] else 0.0) - log10(max(joint.sum(0)[c], 1))
            old = c
        assert got[i] == pytest.approx(total, rel=1e-9)


def test_gain_is_that_of_the_exchange():
    rng, f, n = np.random.default_rng(0), lm_scoring._xlogx, lm_scoring.CLASSES
    joint, cells = rng.integers(50, 400, (n, n)).astype(float), np.zeros((30, lm_scoring.CELLS))
    for w in cells:
        k, own = int(rng.integers(1, n)), int(rng.integers(0, 3))
        w[rng.integers(0, 3 * n, 12)] += rng.integers(1, 4, 12)
        w[lm_scoring.CLASS], w[lm_scoring.OWN] = k, own
        w[[k, n + k]] += own
    for w, got in zip(cells, lm_scoring.gains(cells, joint)):
        k, own, d = int(w[lm_scoring.CLASS]), w[lm_scoring.OWN], np.arange(n)
        right, left = w[:n].copy(), w[n:2 * n] + w[2 * n:3 * n]
        times, size, rest = left.sum(), joint.sum(0), joint.copy()
        right[k] -= own
        left[k] -= own
        size[k] -= times
        rest[k] -= right
        rest[:, k] -= left
        rest[k, k] -= own
        rows, columns = f(rest + right) - f(rest), f(rest + left[:, None]) - f(rest)
        want = rows.sum(1) - rows[d, d] + columns.sum(0) - columns[d, d] + f(rest[d, d] + right + left + own) - f(rest[d, d]) \
            - 2 * (f(size + times) - f(size))
        assert got[1:] == pytest.approx(want[1:], abs=1e-8)


# --- document fingerprints

def test_likeness_of_a_very_repetitive_document(spark):
    """More than 2^15 hits in a lane: 70,000 times the same window, 46,667 of them left after the edit."""
    long = "x y z\n" * 70_000
    docs = spark.createDataFrame([(2, long), (1, "a b c\n" * 70_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.op3(docs).collect()}
    left, new = 46_667, 23_333
    assert got[2]["near_edited"] == pytest.approx(1 - 2 * new ** 2 / (70_000 ** 2 + left ** 2 + new ** 2), abs=1e-3)
    assert got[2]["near_next"] == 0.0
    for times in (1 << 15, 1 << 16, 70_000):
        v = fingerprints.vector(Counter({b"x y z": times}))
        assert np.abs(v[1].view(np.int32)).max() == times


# --- secret scans

def test_a_secret_after_the_first_40_characters_of_a_run_is_found(spark):
    net = secrets.fit(planted(spark))
    rng = random.Random(5)
    path = "/v1/resources/documents/archive/items/key-="
    runs = [path + "".join(rng.choice("0123456789abcdef") for _ in range(28)) for _ in range(100)]
    docs = spark.createDataFrame([(f"the of {r} erin",) for r in runs], "text string")
    found = docs.select(secrets.spans_column(F.col("text"), net).alias("spans")).collect()
    assert np.mean([any(x["end"] == 7 + len(path) + 28 for x in r["spans"]) for r in found]) > 0.9
    assert [secrets.pieces(3, e) for e in (11, 43, 44)] == [[(3, 11)], [(3, 43)], [(3, 43), (4, 44)]]
    for n in (8, 40, 41, 61, 500):
        assert {i for a, b in secrets.pieces(0, n) for i in range(a, b)} == set(range(n))


def test_the_network_sees_what_follows_a_candidate():
    a, b = (secrets.windows([(f"x 12345678 {w}", 2, 10)]) for w in ("secret", "number"))
    assert (a != b).any()


def test_candidates_are_all_runs_and_what_base_spans_leave():
    letters, hexes = "QwErTyUiOpAsDfGhJkLz", "0123456789abcdef" * 2
    text = f"to {letters} XYZWVUTSRQ-{hexes}+ZYXWVUTSRQPO short"
    base = secrets.base_spans(text)
    assert [text[a:b] for a, b in secrets.candidates(text, base)] == [letters, "XYZWVUTSRQ-", "+ZYXWVUTSRQPO"]
    assert secrets.base_spans("bcdef" * 7) == [(0, 2, 35)]


def test_laid_out_texts_give_the_same_candidates_pieces_and_logits():
    texts = ["", "a key-=" + "x9" * 45 + " then 12345678\u2003é中😀 password=hunter2hunter2\0", "password: abcdefgh", "0123456789abcdef" * 3, "first-candidate at last"]
    base = [secrets.base_spans(t) for t in texts]
    codes, begins = secrets.lay_out(texts)
    starts, ends = secrets.runs_in(codes, [(begins[i] + a, begins[i] + b) for i, x in enumerate(base) for a, _, b in x])
    runs = [(i, a, b) for i, t in enumerate(texts) for a, b in secrets.candidates(t, base[i])]
    assert [(begins[i] + a, begins[i] + b) for i, a, b in runs] == list(zip(starts, ends)) and len(runs) > 2
    parts = [(texts[i], *p) for i, a, b in runs for p in secrets.pieces(a, b)]
    a, b, offsets = secrets.pieces_of(starts, ends)
    assert [y - x for _, x, y in parts] == list(b - a) and offsets[-1] == len(parts)
    rows = secrets.windows(parts)
    assert (rows == secrets.gather(codes, a, b)).all()
    net = secrets.Network.fresh()
    assert np.abs(net.logits_at(codes, a, b) - net.forward(rows)[0]).max() < 1e-5
    rows[:, :secrets.BEFORE] = rows[:, secrets.BEFORE + secrets.PIECE:] = 0
    assert np.abs(net.logits_at(codes, a, b, bare=True) - net.forward(rows)[0]).max() < 1e-5


def test_the_threshold_recalls_what_it_must_whatever_the_negatives():
    rng = np.random.default_rng(3)
    for shift in (-30, -8, -1, 2):  # of the positives from 0; negatives lie about 0 but for the first
        good, bad = rng.normal(shift + 8 if shift == -30 else shift, 1, 2000), rng.normal(-20 if shift == -30 else 0, 3, 50_000)
        counts = np.stack([np.bincount(np.floor(x / secrets.BIN + secrets.BINS / 2).astype(int), minlength=secrets.BINS)
                           for x in (bad, good)]).astype(float)
        net = secrets.Network.fresh()
        net.calibrate(counts)
        assert net.recall >= secrets.RECALL and (good >= net.cut).mean() >= secrets.RECALL
        assert net.slope > 0 and 0 <= net.threshold <= 1


def test_a_table_of_eight_documents_trains_the_network(spark):
    """No number of findings switches the network off."""
    rng = random.Random(8)

    def key():
        return "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(24))

    rows = [(i, f"plain words about everything, telephone {5550000 + i}1 and password={key()} more sentences; somebody@example.org"
                f" has token: {key()} ordinary numbers 12345678 secret={key()} nothing") for i in range(7)]
    bare = key()
    rows.append((7, f"ordinary sentences about {bare} and everything"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = secrets.fit(docs)
    assert np.isfinite(net.cut) and net.recall >= secrets.RECALL
    found = {r["doc_id"]: r["spans"] for r in secrets.op10(docs).collect()}
    assert found[7] == "model:25:49" and all("model" not in found[i] for i in range(7))


def test_kept_out_findings_are_counted_whole(spark):
    """The histogram holds every kept-out finding twice: with its context and without it."""
    docs = planted(spark)
    found = [secrets._findings([r["text"]]) for r in docs.collect()]
    n = [sum(int(((label == k) & (rank % secrets.KEPT_OUT == 0)).sum()) for _, label, rank, _, _ in found) for k in (0, 1)]
    assert secrets.logit_histogram(docs.repartition(5), secrets.Network.fresh()).sum(1).tolist() == [2 * x for x in n]


# --- quality rules

def languages(spark):
    """Documents of an unlisted script, of null and of empty language, and one language of junk alone."""
    rng = random.Random(4)
    russian, english = "это мир дом река окно слово время город книга жизнь".split(), "stone river window paper garden letter music".split()

    def prose(words, n=120):
        return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n)) + "."

    rows = [(i, prose(russian), "ru") for i in range(40)]
    rows += [(100 + i, "the " + prose(english) + " and of the to in a", "xx") for i in range(10)]
    rows += [(200 + i, prose(russian if i % 2 else english), None) for i in range(10)]
    rows += [(300 + i, " ".join(str(rng.randrange(10 ** 6)) for _ in range(120)), None) for i in range(3)]
    rows += [(400 + i, prose(english) if i % 2 else " ".join(f"{rng.randrange(10 ** 6)}" for _ in range(100)), "zz") for i in range(2)]
    rows += [(500, prose(english), ""), (501, None, None), (502, "", "ru"), (503, "short", None), (500, prose(english), "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_every_language_has_a_reference_and_null_takes_the_nearest(spark):
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.op9(languages(spark)).collect()}
    assert all(kept[i] for i in [*range(40), *range(100, 110), *range(200, 210), 500])
    assert not any(kept[i] for i in [300, 301, 302, 501, 502, 503])


def test_no_language_given_anywhere(spark):
    docs = languages(spark).withColumn("lang", F.lit(None).cast("string"))
    got = quality_rules.op9(docs.where("doc_id < 40")).collect()
    assert all(r["kept"] and r["char_distance"] < 0.1 for r in got)


@pytest.mark.parametrize("which", ["true", "doc_id >= 200", "doc_id >= 400 and doc_id < 500", "lang is null", "false"])
def test_quality_rules_against_sql_on_rare_languages(spark, which):
    docs = languages(spark).where(which)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "int64", "text": "object", "lang": "object"}))
    con.execute("CREATE VIEW typed AS SELECT doc_id, CAST(text AS VARCHAR) AS text, CAST(lang AS VARCHAR) AS lang FROM documents")
    want = con.execute(quality_rules.oracle_sql().replace("FROM documents", "FROM typed"))
    names = [d[0] for d in want.description]
    got = quality_rules.op9(docs).select(*names).collect()
    assert Counter(tuple(r) for r in got) == Counter(want.fetchall())


def test_moves_equal_those_of_dense_cells():
    """Words choose by the classes they have been seen next to, however their rows are dealt over batches."""
    rng, n = np.random.default_rng(6), lm_scoring.CLASSES
    joint = rng.integers(500, 4000, (n, n)).astype(float)
    words = np.sort(rng.integers(-2 ** 62, 2 ** 62, 60))
    rows, want, codes = [], {}, Counter()
    for i, word in enumerate(words.tolist()):
        k, dense = int(rng.integers(1, n)), np.zeros((1, lm_scoring.CELLS))
        dense[0, lm_scoring.CLASS] = k
        seen = []
        for _ in range(200 if i == 7 else int(rng.integers(1, 4))):  # a row of each task
            cells = np.unique(rng.integers(0, 4 * n, 5)).astype(np.uint8)
            counts = rng.integers(1, 2000, len(cells))
            own = int(rng.integers(0, 2)) if i % 3 else 0
            if own:
                cells, counts = np.array([k, n + k], np.uint8), np.array([own, own])
            rows.append((word, k, own, cells.tobytes(), counts.astype("<u4").tobytes()))
            seen += zip(cells.tolist(), counts.tolist())
            for c, m in zip(cells.tolist(), counts.tolist()):
                dense[0, c if c < 2 * n else c - 2 * n if c < 3 * n else c - n] += m
            dense[0, lm_scoring.OWN] += own
        gain = lm_scoring.gains(dense, joint)[0]
        new = int(gain.argmax()) if gain.max() > gain[k] + 1e-9 else k
        want[word] = (new, new != k)
        for c, m in seen:
            if c < 2 * n:
                codes[c % n * n + new if c >= n else new * n + c] += m

    class Found:
        def __getattr__(self, _):
            return lambda *args: args[0] if callable(args[0]) else self

    choose = lm_scoring.moved(Found(), joint)
    names, kinds = ["word", "class", "own", "cells", "counts"], [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
    for size in (3, 100, 5000):
        got = pa.Table.from_batches(choose(iter(table.to_batches(max_chunksize=size)))).to_pylist()
        assert {r["id"]: (r["class"], r["moves"]) for r in got if r["id"] is not None} == want
        assert {r["code"]: r["n"] for r in got if r["id"] is None} == codes
    with pytest.MonkeyPatch.context() as m:  # as many logarithms as there are neighbours, not one for every class of every word
        logs = []
        m.setattr(lm_scoring, "_xlogx", lambda x, f=lm_scoring._xlogx: logs.append(np.size(x)) or f(x))
        lm_scoring.gains(np.repeat(dense, 500, axis=0), joint)
    assert sum(logs) < 500 * n * 6
