"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables and extra columns with clashing
names, for every document operator and pipeline stage."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skydelay.llm import (fingerprints, language_id, lm_scoring, packing, quality_classifier, quality_rules, queries, secrets,
                          sentencepiece_fst, sharding, simhash)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "thin ther ouer " * 20_000
ROWS = [(1, None, "en", "s", None), (2, "", None, None, 0), (None, "some words here", "en", "s", 15), (3, " \n\t ", "xx", "s", 4),
        (4, "a b c d e", "en", "s", 9), (4, "a b c d e", "en", "s", 9), (5, "a b c d e", "en", "t", 9), (6, LONG, "en", "s", len(LONG)),
        (None, None, None, None, None), (7, "password=abcdefgh12 é中😀", "de", "s", 23), (8, "123 456 !!", "fr", "s", 10)]
#: names that operators use inside or return
EXTRA = ["score", "spans", "row_no", "fp", "shard", "bucket", "number", "stats", "word", "words", "run", "guard", "bits", "length",
         "piece", "kept", "ref", "component_id", "held_out", "ids", "rank", "n", "label", "quality"]
TABLES = ("edges", "one", "empty", "extra")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = {}
    for name in TABLES:
        rows = {"edges": ROWS, "one": ROWS[4:5], "empty": [], "extra": ROWS}[name]
        df = spark.createDataFrame(rows, SCHEMA)
        if name == "extra":
            df = df.select("*", *[F.lit("x").alias(c) for c in EXTRA])
        path = str(tmp_path_factory.mktemp("docs") / f"{name}.parquet")
        df.write.parquet(path)
        out[name] = spark.read.parquet(path)
    labels = spark.createDataFrame([(4, 1, None), (4, 0, 1), (5, None, 0), (None, 1, 0), (6, 0, 0), (7, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    return out, labels


OPERATORS = {
    "op1": lambda d, _: simhash.op1(d), "op2": lambda d, _: sentencepiece_fst.op2(d, queries.PIECE_MODEL),
    "op3": lambda d, _: fingerprints.op3(d), "op4": lambda d, _: lm_scoring.op4(d),
    "op5": lambda d, _: packing.op5(d, queries.WORD_VOCABULARY), "op6": quality_classifier.op6,
    "op7": lambda d, _: language_id.op7(d), "op8": lambda d, _: sharding.op8(d), "op9": lambda d, _: quality_rules.op9(d),
    "op10": lambda d, _: secrets.op10(d),
}


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(tables, name):
    docs, labels = tables
    run = OPERATORS[name]
    got = {k: run(docs[k], labels).collect() for k in TABLES}
    assert got["empty"] == [] and len(got["one"]) == 1
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got["edges"] if name != "op5" or r["piece"] == 0)
    assert ids == sorted((r[0] is None, r[0] or 0) for r in ROWS)  # one row for each input row (of op5: first pieces)
    if name not in ("op8", "op5"):  # these two place rows by number
        assert ordered(got["edges"]) == ordered(got["extra"])
    by_id = {r["doc_id"]: r for r in got["edges"]}
    if name == "op1":
        assert [by_id[i]["fingerprint"] for i in (1, 2, 3)] == ["0" * 16] * 3
        assert [by_id[i]["component_id"] for i in (1, 2, 3, 4, 5)] == [1, 1, 1, 4, 4]
    elif name == "op3":
        assert by_id[1]["n_chars"] == 0 and by_id[5]["near_next"] == 1.0
    elif name == "op4":
        assert by_id[1]["n_tokens"] == 1 and by_id[6]["n_tokens"] == 60_001
    elif name == "op5":
        assert by_id[1]["length"] == 1 and max(r["length"] for r in got["edges"]) == 2048
    elif name == "op6":
        assert by_id[1]["score"] == by_id[2]["score"] and all(0 <= r["score"] <= 1 for r in got["edges"])
    elif name == "op7":
        assert [by_id[i]["lang_pred"] for i in (1, 2, 3, 8)] == ["und"] * 4 and by_id[4]["lang_pred"] != "und"
    elif name == "op9":
        assert by_id[6]["n_repeat_words"] == 60_000 and by_id[6]["base_failed"] and not by_id[1]["kept"]
    elif name == "op10":
        assert by_id[7]["spans"] == "assign:0:19" and by_id[1]["spans"] == ""


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("table", ["edges", "extra", "empty"])
def test_stage_edges(spark, tables, stage, table, tmp_path):
    docs, labels = tables
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = dict(corpus_pipeline.STAGES)[stage](spark, docs[table], str(tmp_path))
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == list(corpus_pipeline.COLUMNS)
    rows = got.collect()
    if table == "empty":
        assert rows == []
    elif stage == "simhash_near_dedup":
        kept = [r["doc_id"] for r in rows]
        assert kept.count(4) == 1 and 5 not in kept and 1 in kept and 2 not in kept
    elif stage == "secret_scan":
        masked = next(r for r in rows if r["doc_id"] == 7)
        assert len(rows) == len(ROWS) and masked["text"] == "<secret> é中😀" and masked["n_chars"] == len(masked["text"])


def test_pipeline_runs(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bad = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    ids = {r["doc_id"] for r in rows}
    assert ids < {r["doc_id"] for r in docs.collect()} and len(ids & bad) <= 0.1 * len(bad)
    texts = [r["text"] for r in docs.where(F.col("doc_id").isin(list(ids))).collect()]
    assert len(texts) == len(set(texts))
