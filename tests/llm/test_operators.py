"""Each document operator against a brute-force version, an exact round trip or held-out accuracy."""
import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from skydelay.llm import (fingerprints, language_id, lm_scoring, packing, quality_classifier, quality_rules, queries, secrets,
                          sentencepiece_fst, sharding, simhash)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def groups(ids, near):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


# --- SimHash near-dedup

def brute_print(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(docs, texts):
    got = {r["doc_id"]: r for r in simhash.op1(docs).collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    expect = groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {i: r["component_id"] for i, r in got.items()} == expect


@pytest.mark.parametrize("dense", [2, 6, 1000])
def test_links_of_dense_clusters(spark, dense):
    """Clusters far denser than a bucket may be: every way of cutting must find the same components."""
    rng = random.Random(dense)
    values = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x - (1 << 64) if x >> 63 else x)
    values |= {rng.getrandbits(62) for _ in range(40)}
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    found = [(r["a"], r["b"]) for r in simhash.links(fps, dense=dense).collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 3 for a, b in found)
    pairs = set(found) | {(b, a) for a, b in found}
    ids = sorted(values)
    assert groups(ids, lambda a, b: (a, b) in pairs) == groups(ids, lambda a, b: ((a ^ b) & mask).bit_count() <= 3)


# --- SentencePiece

def test_transducer_equals_the_library(docs, texts):
    import sentencepiece
    path = queries.PIECE_MODEL
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        coder = sentencepiece_fst.Transducer(f.read())
    rng = random.Random(1)
    odd = ["", " ", "  a  ", "a  b   c    d     e", "▁a▁ ▁b", "\n\t\r\x0b x\x00y", "中文 é ﬁ 😀😀 á", "word" * 500]
    odd += ["".join(rng.choice("   ▁ab\ntheé中 ,.1!²'\"") for _ in range(50)) for _ in range(300)]
    for text in odd + list(texts.values())[:60]:
        ids = np.frombuffer(coder.encode(text), "<u4").tolist()
        assert ids == library.encode(text), text
        assert coder.decode(ids) == library.decode(ids)
    for r in sentencepiece_fst.op2(docs, path).collect()[:100]:
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_ids"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()  # an exact round trip
    back = docs.select("text", sentencepiece_fst.encode_column(F.col("text"), path).alias("ids")) \
        .select("text", sentencepiece_fst.decode_column(F.col("ids"), path).alias("back"))
    assert back.where("text <> back").count() == 0


def test_transducer_of_a_unigram_model():
    def field(number, payload):
        return bytes([number << 3 | 2, len(payload)]) + payload

    def piece(text, score, kind=1):
        return field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + np.float32(score).tobytes() + bytes([3 << 3, kind]))
    model = piece("<unk>", 0, 2) + piece("▁", -3) + piece("a", -2) + piece("b", -2) + piece("ab", -3) + piece("▁a", -4.5) \
        + field(2, bytes([3 << 3, 1]))
    coder = sentencepiece_fst.Transducer(model)
    assert [coder.pieces[i][0] for i in np.frombuffer(coder.encode("ab"), "<u4")] == ["▁", "ab"]
    assert [coder.pieces[i][0] for i in np.frombuffer(coder.encode("x"), "<u4")] == ["▁", "<unk>"]


# --- document fingerprints

def test_fingerprints(docs, texts):
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.op3(docs).collect()}
    assert len(got) == len(order)
    for k, i in enumerate(order):
        text, following = texts[i], texts[order[(k + 1) % len(order)]]
        n = len(text) // 3
        new = text[:len(text) - n] + following[:n]
        own, changed, other = (fingerprints.vector(Counter(fingerprints.paragraphs(t))) for t in (text, new, following))
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.packed(own) and r["edited_fingerprint"] == fingerprints.packed(changed)
        assert r["near_edited"] == fingerprints.likeness(own, changed) and r["near_next"] == fingerprints.likeness(own, other)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.95


def test_fingerprint_is_a_multiset_hash():
    v = fingerprints.vector
    a, b, c = Counter([b"one two three four"]), Counter([b"x y"]), Counter([b"one two three four", b"x y", b"x y"])
    c[b"x y"] = 2
    total = fingerprints.add(fingerprints.add(v(b), v(a)), v(b))
    assert fingerprints.packed(total) == fingerprints.packed(v(c)) != fingerprints.packed(v(a))
    assert fingerprints.packed(fingerprints.subtract(total, v(Counter({b"x y": 2})))) == fingerprints.packed(v(a))


# --- LM scoring

def test_lm_base_and_held_out_score(docs, texts):
    got = {r["doc_id"]: r for r in lm_scoring.op4(docs).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: WORD.findall(lower(t)) + ["\n"] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in counts for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    assert sum(r["score"] for r in got.values() if r["held_out"]) > sum(r["base_score"] for r in got.values() if r["held_out"])


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(2)
    counts = np.zeros((13, 13))
    for _ in range(4000):  # even units follow odd ones and the reverse
        a, b = rng.integers(0, 6, 2)
        counts[2 * a, 2 * b + 1] += 1
        counts[2 * b + 1, 2 * a] += 1
    got = lm_scoring.exchange(counts, classes=3)
    assert len(set(got[0:12:2])) == len(set(got[1:12:2])) == 1 and got[0] != got[1] and got[12] == 0


def test_class_model_is_a_distribution():
    words = [b"a", b"b", b"c", b"d"] * 5 + [b"e", b"f"]
    rng = random.Random(0)
    text = [rng.choice(words) for _ in range(400)] + [b"zz"]
    counts = Counter(text)
    counts[lm_scoring.END] = 1
    units = lm_scoring._Units([w for w, _ in counts.most_common() if w != lm_scoring.END])
    seq = [lm_scoring.END_UNIT] + [units[w] for w in text] + [lm_scoring.END_UNIT]
    grams = np.zeros((lm_scoring.UNITS, lm_scoring.UNITS))
    np.add.at(grams, (seq[:-1], seq[1:]), 1)
    model = lm_scoring.ClassModel(counts.most_common(), grams, 0.5)
    kinds = Counter(model.class_of(w) for w in counts if w != lm_scoring.END)
    for context in range(lm_scoring.CLASSES):
        total = 10 ** model.transition[context, 0]
        for w, n in counts.items():
            if w != lm_scoring.END:
                c = model.class_of(w)
                total += 10 ** model.transition[context, c] * (n - 0.5) / model.size[c]
        total += sum(10 ** model.transition[context, c] * (0.5 * kinds[c] / model.size[c] if kinds[c] else 1)
                     for c in range(1, lm_scoring.CLASSES))
        assert total == pytest.approx(1.0)


# --- best-fit packing

def test_packing(docs, texts):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.op5(docs, queries.WORD_VOCABULARY).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = np.array(library.encode(texts[i], add_special_tokens=False).ids + [0], dtype="<u4")
        own.sort(key=lambda r: r["piece"])
        for k, r in enumerate(own):
            part = ids[2048 * k:2048 * (k + 1)]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (k, 2048 * k, len(part), zlib.crc32(part.tobytes()))
        assert sum(r["length"] for r in own) == len(ids)
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_part_encoder_equals_the_tokenizer():
    coder = packing.PartEncoder(queries.WORD_VOCABULARY)
    rng = random.Random(4)
    odd = ["Å x <|endoftext|> Hi yo's 12 'S don't\x0b<|ENDOFTEXT|>", "", "ÉÀ İ 中文 ﬁ á x\xa0y\x85z a\xadb ½² «x» \x1c Σας ẞ"]
    odd += ["".join(chr(rng.choice([*range(1, 0x260), 0x301, 0x2019, 0x4E2D])) for _ in range(80)) for _ in range(200)]
    for text in odd:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    for capacity, most in ((16, 9), (64, 30), (64, 3)):
        counts = np.zeros(capacity + 1, dtype=np.int64)
        counts[1:] = rng.integers(0, most, capacity)
        plan = packing.plan(counts)
        used = sum(np.bincount(p, minlength=capacity + 1) * k for p, k in plan)
        assert (used == counts).all() and all(sum(p) <= capacity for p, _ in plan)
        least = max(-(-int((counts * np.arange(capacity + 1)).sum()) // capacity), int(counts[capacity // 2 + 1:].sum()))
        assert sum(k for _, k in plan) <= 1.05 * least + 2
    assert packing.plan(np.zeros(9)) == []


# --- quality classifier, language identification: held-out accuracy

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_classifier.op6(d, labels).join(labels, "doc_id").collect()
    own = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in own]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(3)
    total = rng.integers(0, 5, 200).astype(float)
    good = np.minimum(total, rng.integers(0, 5, 200)).astype(float)
    steps = quality_classifier.isotonic(good, total)
    assert (np.diff(steps) >= 0).all() and 0 <= steps.min() and steps.max() <= 1


def test_language_held_out(docs, texts):
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = language_id.op7(docs).collect()
    own = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in own]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_kneser_ney_adds_up_to_one():
    codes, _ = language_id.codes_of(["the", "then", "hat", "tatze", "é"])
    seen, counts = np.unique(codes, return_counts=True)
    model = language_id.KneserNey(seen, counts.astype(float))
    for context in (0, 20 * 64 + 8, 5 * 64 + 6, 63 * 64 + 63):
        assert (10 ** model.log10(context * 64 + np.arange(64))).sum() == pytest.approx(1.0)


# --- sharding

def test_sharding(docs, texts):
    rows = sharding.op8(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "rows")
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(40)]
    assert max(counts) - min(counts) <= 1


def test_shuffle_of_many_small_buckets(docs):
    def order(**options):
        return [r["doc_id"] for r in sharding.shuffled(docs, bucket_bytes=20_000, **options).orderBy("shard", "slot").collect()]
    one, other = order(seed=1), order(seed=2)
    assert one == order(seed=1) != other and sorted(one) == sorted(other)
    assert abs(np.corrcoef(one, np.arange(len(one)))[0, 1]) < 0.3


# --- quality rules

def test_quality_rules_base(docs, texts):
    for r in quality_rules.op9(docs).collect():
        text = texts[r["doc_id"]]
        words = WORD.findall(text)
        windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        seen, again = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed)
        assert not (failed and r["kept"])


def test_quality_rules_judge_by_distance(spark):
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_rules.op9(clean).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("NOT base_failed")
    shares = {r["quality"]: r["kept"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[1] > 0.99 and shares[0] < 0.3


# --- secret scans

def planted(spark):
    rng = random.Random(8)
    words = "the of and to stor erin thha onou whst edin".split()

    def fill(n):
        return " ".join(rng.choice(words) for _ in range(n))

    def key(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))
    rows = []
    for i in range(300):
        hexes, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        secret = ["AKIA" + key(upper, 16), f"password={key(hexes, 18)}", f'token = "{key(hexes, 40)}"', f"Api_Key: '{key(hexes, 24)}'"][i % 4]
        plain = [f"{fill(1)}.{i % 90:02d}@mail{i % 9}.example.com", f"4{key('0123456789', 15)}", f"{i % 255}.{i % 99}.{i % 77}.12", "555-1234 v2.0.1"][i % 4]
        rows.append((i, f"{fill(30)} {secret} {fill(20)}\n{plain} {fill(5)}"))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_secret_scan(spark):
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
                        r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    d = planted(spark)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    got = {r["doc_id"]: r for r in secrets.op10(d).collect()}
    for i, t in texts.items():
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert r["n_model"] == 0 or set(text.split(",")) <= set(r["spans"].split(","))


def test_network_learns_and_finds_bare_secrets(spark):
    """Secrets without a keyword are found and ordinary numbers are not (documents the network was not trained on)."""
    net = secrets.fit(planted(spark))
    rng = random.Random(77)

    def codes(make):
        found = []
        for _ in range(100):
            t = "the of and " + make() + " erin"
            found.append((t, 11, len(t) - 5))
        return net.score(secrets.windows(found)) >= net.threshold
    assert codes(lambda: "".join(rng.choice("0123456789abcdef") for _ in range(28))).mean() > 0.9
    assert codes(lambda: "4" + "".join(rng.choice("0123456789") for _ in range(15))).mean() < 0.05
    assert codes(lambda: f"stor.{rng.randint(10, 99)}@mail{rng.randint(0, 9)}.example.com").mean() < 0.05


def test_network_gradients():
    net = secrets.Network.fresh()
    rng = np.random.default_rng(0)
    x, error = rng.integers(0, 98, (7, secrets.BEFORE + secrets.INSIDE)), rng.normal(size=7)
    _, state = net.forward(x)
    for p, g in zip(net.parameters(), net.gradients(state, error)):
        at = tuple(rng.integers(0, n) for n in p.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = net.forward(x)[0] @ error
        p[at] = old - 1e-5
        down = net.forward(x)[0] @ error
        p[at] = old
        assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-4)


def test_redaction(spark):
    item = "array<struct<kind int, start int, end int>>"
    d = spark.createDataFrame([("a secret=b c", [(0, 2, 10), (2, 9, 10)]), ("none", []), (None, [])], f"text string, spans {item}")
    got = [r[0] for r in d.select(secrets.redacted_column(F.col("text"), F.col("spans"))).collect()]
    assert got == ["a <secret> c", "none", None]


