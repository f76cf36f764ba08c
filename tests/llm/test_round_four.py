"""Faults found in round 3: every script keeps its letters (op7)."""

import random
import zlib

from skydelay.llm import language_id


def test_languages_in_disjoint_letters_of_one_block(spark):
    rng = random.Random(1)
    letters = {"aa": "абвгдежзийклмноп", "bb": "рстуфхцчшщъыьэюя", "cc": "αβγδεζηθικλμ", "dd": "νξοπρστυφχψω"}
    rows = []
    for i in range(240):
        lang = sorted(letters)[i % 4]
        words = ["".join(rng.choices(letters[lang], k=5)) for _ in range(12)]
        rows.append((i, " ".join(words), lang))
    got = {r["doc_id"]: r for r in language_id.op7(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 50 and all(got[i]["lang_pred"] == rows[i][2] for i in held)
    assert all(got[i]["score"] > 0.9 for i in held)


def test_codes_tell_all_characters_apart():
    words = ["да", "ея", "你好", "您好", "\U00010400a", "\U00010401a"]
    codes, offsets = language_id.codes_of(words)
    assert len({tuple(codes[a:b].tolist()) for a, b in zip(offsets, offsets[1:])}) == len(words) and (codes > 0).all()
