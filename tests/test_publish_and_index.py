"""Rarest-key containment, the segmented scan, partition registration and two-phase publication."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skydelay.operators import containment as C
from skydelay.operators.ranking import carry_route_forward, search_callsigns
from skydelay.sources import io as IO


@pytest.mark.parametrize("cell", [3, 10_000])
def test_containment_against_brute_force(spark, cell):
    rng = random.Random(cell)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 9))) for _ in range(150)]
    needles = texts[:60] + ["a", "ab", "zzz", "", "abé"]
    n, h = (spark.createDataFrame([(t,) for t in x], f"{name} string") for x, name in ((needles, "needle"), (texts, "hay")))
    got = {tuple(r) for r in C.contained(n, h, "needle", "hay", cell).collect()}
    assert got == {(a, b) for a in set(needles) if a for b in set(texts) if a in b}
    sets = [sorted({rng.choice("pqrstu") for _ in range(rng.randint(0, 4))}) for _ in range(80)]
    n, h = (spark.createDataFrame([(t,) for t in sets], f"{name} array<string>") for name in ("a", "b"))
    got = {(tuple(r["a"]), tuple(r["b"])) for r in C.nested(n, h, "a", "b", cell).collect()}
    assert got == {(tuple(a), tuple(b)) for a in sets if a for b in sets if set(a) <= set(b)}


def test_a_prefix_that_all_names_share_is_no_key(spark):
    """100,000 names that start alike: no needle looks the shared grams up, and no group holds more than a cell."""
    names = spark.range(100_000).select(F.concat(F.lit("international "), F.md5(F.col("id").cast("string"))).alias("name"))
    needles = names.where("name like '%000'").unionByName(spark.createDataFrame([("international ",)], "name string")).withColumnRenamed("name", "needle")
    n = needles.withColumn("k", C.own_grams(F.col("needle")))
    keys = C.rarest_keys(n, names.withColumn("h", C.grams(F.col("name"))), "needle", "k", "h").collect()
    shared = {"international "[i:i + 3] for i in range(12)}
    assert len(keys) > 5 and all((r["__k"] in shared) == (r["needle"] == "international ") for r in keys)
    assert max(r["__count"] for r in keys if r["needle"] != "international ") < 10_000
    got = C.contained(needles.where("needle <> 'international '"), names, "needle", "name")
    assert {r["needle"] for r in got.collect()} == {r["name"] for r in got.collect()}
    assert C.contained(needles.where("needle = 'international '"), names, "needle", "name").count() == 100_000


def test_callsign_search_against_brute_force(spark):
    rng = random.Random(8)
    calls = ["".join(rng.choice("ABC1") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    asked = {1: "a", 2: " AB ", 3: "zz", 4: "", 5: "C1A", 6: "ABC1"}
    got = search_callsigns(spark.createDataFrame([(c,) for c in calls], "callsign string"),
                           spark.createDataFrame(list(asked.items()), "query_id int, query string"), 5).collect()
    for i, q in asked.items():
        q = q.strip().upper()
        want = sorted((c for c in set(calls) if q in c), key=lambda c: (not c.startswith(q), c))[:5]
        assert [r["callsign"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == want


def test_segmented_scan_equals_the_window(spark):
    rng = random.Random(9)
    pick = lambda x: rng.choice([None, None, None, " ", x])
    rows = [("long" if i % 4 else f"s{i % 60}", i, pick(f"A{i}"), pick(f"C{i}"), pick(f"B{i}"), None) for i in range(3000)]
    rows += [(None, i, pick("Z"), None, None, None) for i in range(5)]
    cols = "session_id string, turn int, origin_airport string, origin_country string, destination_airport string, destination_country string"
    df = spark.createDataFrame(rows, cols).repartition(5)
    w = Window.partitionBy("session_id").orderBy("turn")
    want = df
    for side in ("origin", "destination"):
        a, c = F.col(f"{side}_airport"), F.col(f"{side}_country")
        v = F.last(F.when((F.trim(a) != "") | (F.trim(c) != ""), F.struct(a.alias("airport"), c.alias("country"))), ignorenulls=True).over(w)
        want = want.withColumn("v", v).withColumns({f"carried_{side}_{p}": F.col("v")[p] for p in ("airport", "country")}).drop("v")
    got = carry_route_forward(df)
    key = lambda d: sorted((tuple(r) for r in d.select(*want.columns).collect()), key=str)
    assert key(got) == key(want)
    # the long session lies in several pieces
    assert got.select("session_id", F.spark_partition_id().alias("p")).where("session_id = 'long'").distinct().count() > 1


@pytest.fixture
def table(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS pub_test")
    name = "pub_test.t"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    yield name, str(tmp_path / "t")
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_a_second_sync_sends_no_statement(spark, table, monkeypatch):
    name, path = table
    spark.sql(f"CREATE TABLE {name} (v INT, year INT, month INT) USING parquet PARTITIONED BY (year, month) LOCATION '{path}'")
    pairs = spark.range(5000).selectExpr("cast(1 + id div 12 as int) AS year", "cast(1 + id % 12 as int) AS month").unionByName(
        spark.createDataFrame([(None, 1)], "year int, month int"))
    sent, real = [], type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, q, *a, **k: (sent.append(q), real(self, q, *a, **k))[1])
    assert IO.sync_partitions(spark, name, pairs).count() == 5000
    assert sum("ALTER TABLE" in q for q in sent) == 10 and spark.sql(f"SHOW PARTITIONS {name}").count() == 5000
    sent.clear()
    assert IO.sync_partitions(spark, name, pairs).count() == 0 and not any("ALTER TABLE" in q for q in sent)


@pytest.mark.parametrize("step", ["stage", "check", "swap", "register"])
def test_publication_is_repeatable_after_a_crash(spark, table, step):
    name, path = table
    frame = lambda v, years: spark.range(40).selectExpr(f"id * {v} AS v", f"cast(2000 + id % {years} as int) AS year", "cast(1 + id % 2 as int) AS month")
    IO.publish(frame(1, 4), path, name, "one")

    def crash(done):
        if done == step:
            raise InterruptedError
    with pytest.raises(InterruptedError):
        IO.publish(frame(7, 2), path, name, "two", after=crash)
    IO.publish(frame(7, 2), path, name, "two")
    rows = spark.table(name).groupBy("year").agg(F.count("*").alias("n"), F.sum("v").alias("s")).orderBy("year").collect()
    new = [sum(7 * i for i in range(40) if i % 2 == k) for k in (0, 1)]
    old = [sum(i for i in range(40) if i % 4 == k) for k in (2, 3)]
    assert [tuple(r) for r in rows] == [(2000, 20, new[0]), (2001, 20, new[1]), (2002, 10, old[0]), (2003, 10, old[1])]
    with pytest.raises(ValueError):
        IO.publish(frame(1, 4).limit(0), path, name, "none")
