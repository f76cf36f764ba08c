"""Merkle manifest, exact dedup and conversation repair against brute force, and their edge cases."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skydelay.llm import conversation_repair, exact_dedup, merkle, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Thin Ther ouer " * 20_000
ROWS = [(1, None, "en", "s", None), (2, "", None, None, 0), (None, "some Words here", "en", "s", 15), (3, " \n\t ", "xx", "s", 4),
        (4, "a B c d e", "en", "s", 9), (4, "a B c d e", "en", "s", 9), (5, "a B c d e", "en", "t", 9), (6, LONG, "en", "s", len(LONG)),
        (None, None, None, None, None), (7, "Password é中😀", "de", "s", 23), (8, "123 456 !!", "fr", "s", 10)]
EXTRA = ["tree", "idx", "n", "node", "kids", "kid", "seg", "leaf", "present", "digest", "delivery", "row_no", "keep_id", "kept",
         "group_size", "_at", "_group", "code", "number", "place", "letters", "copy", "kind", "fault", "c", "audit"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, rows, schema, tmp_path, extra=False):
    df = spark.createDataFrame(rows, schema)
    if extra:
        df = df.select("*", *[F.lit("x").alias(c) for c in EXTRA])
    path = str(tmp_path / f"t{extra}.parquet")
    df.write.parquet(path)
    return spark.read.parquet(path)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


# --- Merkle manifest

def brute_manifest(rows):
    """rows: dicts of the table's columns -> tuples as op11 returns them, by the contract's words."""
    def leaf(r, text):
        parts = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))

    def up(level):
        """Levels of a tree, lowest first."""
        out = [level]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def way(levels, i):
        for level in levels[:-1]:
            run = level[i // 8 * 8:i // 8 * 8 + 8]
            yield "".join(run[:i % 8]), "".join(run[i % 8 + 1:])
            i //= 8

    def now(r):
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
        return re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]) if hit else r["text"]
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, now(r)), r["doc_id"]))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: up([x[2] for x in sorted(by_lang[lang])]) for lang in langs}
    top = up([trees[lang][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        for i, (_, _, own, present, doc_id) in enumerate(sorted(by_lang[lang])):
            steps = [*way(trees[lang], i), *way(top, place)]
            folded = present
            for left, right in steps:
                folded = sha(left + folded + right)
            out.append((doc_id, own, trees[lang][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def test_manifest_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = ordered(merkle.op11(docs).collect())
    assert got == brute_manifest([r.asDict() for r in docs.collect()])
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n,langs", [(1, 1), (8, 1), (9, 1), (70, 9)])
def test_manifest_shapes(spark, n, langs, tmp_path):
    rows = [(i, f"Text {i}", None if i % langs == 0 else f"l{i % langs}", "s", i) for i in range(n)]
    docs = table(spark, rows, SCHEMA, tmp_path)
    assert ordered(merkle.op11(docs).collect()) == brute_manifest([r.asDict() for r in docs.collect()])


def test_manifest_edges(spark, tmp_path):
    docs, extra = (table(spark, ROWS, SCHEMA, tmp_path, e) for e in (False, True))
    want = brute_manifest([r.asDict() for r in docs.collect()])
    assert ordered(merkle.op11(docs).collect()) == want == ordered(merkle.op11(extra).collect())
    assert merkle.op11(docs.limit(0)).collect() == []


def test_manifest_finds_every_kind_of_change(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    for field, value in (("text", F.lit(None).cast("string")), ("source", F.lit("")), ("n_chars", F.lit(11).cast("long"))):
        got = merkle.manifest(docs, {field: F.when(F.col("doc_id") == 77, value).otherwise(F.col(field))}).collect()
        assert [r["doc_id"] for r in got if not r["verified"]] == [77]


# --- exact dedup

def brute_dedup(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append((r["doc_id"] is not None, r["doc_id"] or 0, r["doc_id"]))
    out = []
    for text, members in groups.items():
        members.sort()
        out += [(m[2], members[-1][2], len(members), i == len(members) - 1, sha(text)) for i, m in enumerate(members)]
    return sorted(out, key=str)


def test_dedup_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert ordered(exact_dedup.op12(docs).collect()) == brute_dedup([r.asDict() for r in docs.collect()])
    edges, extra = (table(spark, ROWS, SCHEMA, tmp_path, e) for e in (False, True))
    want = brute_dedup([r.asDict() for r in edges.collect()])
    assert ordered(exact_dedup.op12(edges).collect()) == want == ordered(exact_dedup.op12(extra).collect())
    assert exact_dedup.op12(edges.limit(0)).collect() == []


def test_index_persists_and_repeats(spark, tmp_path):
    """Later deliveries are held against the stored index; adding one again changes nothing; the index is neither
    shuffled nor broadcast."""
    def rows(*pairs):
        return exact_dedup.digests(spark.createDataFrame(pairs, "doc_id long, text string"))
    spark.sql("DROP TABLE IF EXISTS digests_test")
    index = exact_dedup.DigestIndex.create(spark, "digests_test", str(tmp_path / "index"), buckets=8)
    first, second = rows((1, "a"), (2, "a"), (3, "b")), rows((9, "a"), (10, "c"), (11, "c"), (None, "d"))
    index.add(first)
    index.add(second)
    held = sorted((r["keep_id"] or 0, r["digest"].hex()) for r in index.frame().collect())
    assert held == sorted((i, sha(t)) for i, t in ((2, "a"), (3, "b"), (11, "c"), (0, "d")))
    again = exact_dedup.DigestIndex(spark, "digests_test")
    again.add(second)
    assert again.frame().count() == 4
    got = ordered(again.verdicts(second).drop("digest").collect())
    assert got == sorted([(9, 2, 1, False), (10, 11, 2, False), (11, 11, 2, True), (None, None, 1, True)], key=str)
    plan = again.new_groups(second)._jdf.queryExecution().toString()
    join = plan[plan.index("Physical Plan"):]
    assert "SortMergeJoin" in join and "Broadcast" not in join and "Bucketed: true" in join
    spark.sql("DROP TABLE digests_test")


# --- conversation repair

def brute_alignment(codes):
    """Least (cost, audit) over all edit sequences by exhaustive recursion over the grammar's states."""
    from functools import cache
    n = len(codes)

    @cache
    def best(i, state, inserts):
        """state: '' nothing yet, 's', 'u', 'a' the last letter put down."""
        found = []
        if i == n and state in ("", "a"):
            found.append((0, ""))
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if inserts:
            c, x = best(i, after, inserts - 1)
            found.append((c + 5, "I" + x))
        if i < n:
            initial, fault = codes[i] & 3, codes[i] >> 2
            c, x = best(i + 1, state, 3)
            found.append((c + 2, "D" + x))
            late = 5 if fault == 1 else 0
            if fault < 2:
                same = initial == {"u": 1, "a": 2}[after]
                c, x = best(i + 1, after, 3)
                found.append((c + late + (not same), ("K" if same else "R") + x))
                if state == "" and initial == 3:
                    c, x = best(i + 1, "s", 3)
                    found.append((c + late, "K" + x))
        return min(found, default=(10 ** 9, ""))
    return best(0, "", 3)


def test_alignment_against_brute_force():
    rng = random.Random(5)
    for k in range(1500):
        n = rng.randint(1, 14)
        if k % 3:
            codes = [rng.choice((1, 2, 3, 0)) + 4 * rng.choice((0, 0, 0, 1, 2, 3)) for _ in range(n)]
        else:
            codes = [(1 if i % 2 == 0 else 2) + 4 * rng.choice((0, 0, 0, 0, 1, 2)) for i in range(n)]
            codes = [c for c in codes if rng.random() > 0.1] or [3]
        assert conversation_repair.Alignment(np.array(codes, dtype=np.uint8)).solve() == brute_alignment(tuple(codes)), codes


def test_long_alignment():
    """A conversation of 5,000 damaged turns: the table's memory is far below rows x band and the result is exact."""
    rng = random.Random(6)
    codes = np.array([c for i in range(5000) if rng.random() > 0.05
                      for c in [(1 + i % 2) + 4 * rng.choice([0] * 16 + [1, 2, 3])]], dtype=np.uint8)
    import sys
    sys.setrecursionlimit(100_000)
    align = conversation_repair.Alignment(codes)
    cost, audit = align.solve()
    assert sum(len(c) for _, c in align.kept.values()) < 100 * 5000
    # least cost over the grammar's states, a pass over the rows
    states = {"": 0}
    for c in codes.tolist():
        initial, fault, new = c & 3, c >> 2, {}
        for _ in range(2):
            for s, v in list(states.items()):
                after = {"": "u", "s": "u", "u": "a", "a": "u"}[s]
                states[after] = min(states.get(after, 10 ** 9), v + 5)
        for s, v in states.items():
            after = {"": "u", "s": "u", "u": "a", "a": "u"}[s]
            steps = [(s, 2)] + ([(after, (initial != {"u": 1, "a": 2}[after]) + (5 if fault == 1 else 0))] if fault < 2 else [])
            for t, price in steps:
                new[t] = min(new.get(t, 10 ** 9), v + price)
        states = new
    assert cost == min(states.get("", 10 ** 9), states["a"], states["u"] + 5)
    assert len(audit.replace("I", "")) == len(codes)


def brute_repair(rows):
    """rows: (conv_id, turn, role, text) -> tuples as op13 returns them."""
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        here = by_conv[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        here += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, turns in by_conv.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        codes, seen, count = [], set(), [0, 0, 0]
        for _, role, text in turns:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 2 if not words else 3 if (role, text) in seen else 1 if words[-1] not in ".!?" else 0
            seen.add((role, text))
            codes.append({"u": 1, "a": 2, "s": 3}.get(role[:1], 0) + 4 * fault)
            for k, f in enumerate((2, 3, 1)):
                count[k] += fault == f
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = brute_alignment(tuple(codes)) if codes else (0, "")
        lines, i, want = [], 0, "user"
        for letter in audit:
            if letter == "I":
                lines.append(f"{want}:")
            elif letter == "D":
                i += 1
                continue
            else:
                _, role, text = turns[i]
                i += 1
                if letter == "K" and role[0] == "s":
                    lines.append(f"{role}:{text}")
                    continue
                lines.append(f"{role if letter == 'K' else want}:{text}")
            want = "assistant" if want == "user" else "user"
        out.append((conv, gaps, *count, illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=str)


def test_repair_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/../sf0.01/conversations.parquet")
    got = ordered(conversation_repair.op13(rows).collect())
    assert got == brute_repair([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows.collect()])
    assert any("R" in r[7] for r in got) and any("KDK" in r[7] for r in got)


def test_repair_edges(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 0, "user", "a."), (None, 1, "assistant", "b"), (1, None, "user", "x."), (1, None, None, None), (1, 3, "", ""),
            (2, 0, "user", "same."), (2, 0, "user", "same."), (2, 9, "assistant", LONG + "é!"), (3, None, None, None),
            (4, 5, "system", "s."), (4, 6, "Zulu", "😀.  \n"), (4, -3, "assistant", "中?")]
    rows += [(5, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(12)]
    rows += [(100 + i, i, "user", "one.") for i in range(60)]  # some of these lose their only turn
    turns, extra = (table(spark, rows, schema, tmp_path, e) for e in (False, True))
    want = brute_repair(rows)
    got = ordered(conversation_repair.op13(turns).collect())
    assert got == want == ordered(conversation_repair.op13(extra).collect())
    assert any(r[6:8] == (0, "") and r[8] == sha("") for r in got)
    assert conversation_repair.op13(turns.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_exact_dedup"])
def test_oracles(spark, name):
    import duckdb
    run, sql = queries.QUERIES[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    want = sorted((tuple(r) for r in out.fetchall()), key=str)
    assert ordered(run(spark, SF).select(*names).collect()) == want
