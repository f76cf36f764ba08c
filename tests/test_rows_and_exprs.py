import datetime as dt

from pyspark.sql import functions as F

from skydelay.functions import exprs as X
from skydelay.operators import chat as C
from skydelay.operators import rows as B


def test_clean_keeps_null_cancelled(spark):
    df = spark.createDataFrame([(1, None, 10.0), (2, 1, 10.0), (3, 0, None), (4, 0, 501.0), (5, 0, -30.0), (6, None, "x")],
                               "id int, CANCELLED int, ARRIVAL_DELAY string")
    out = sorted(r.id for r in B.clean_flights(df).collect())
    assert out == [1, 5]


def test_dep_hour_and_labels(spark):
    df = spark.createDataFrame([(None,), (2515,), (459,), (1230,), (1730,), (2200,)], "d int")
    rows = df.select(X.dep_hour("d").alias("h"), X.time_of_day(X.dep_hour("d")).alias("t")).collect()
    assert [(r.h, r.t) for r in rows] == [(0, "night"), (23, "night"), (4, "night"), (12, "afternoon"),
                                          (17, "evening"), (22, "night")]


def test_hhmm_helpers(spark):
    df = spark.createDataFrame([("930",), ("2515",), (" 7:05 ",), ("abc",), ("",), (None,), ("1299",)], "v string")
    rows = df.select(X.format_hhmm("v").alias("f"), X.departure_sort_key("v").alias("k"),
                     X.clamp_hhmm("v").alias("c")).collect()
    assert [r.f for r in rows] == ["09:30", "23:59", "7:05", "abc", None, None, "12:59"]
    assert [r.k for r in rows] == [930, 2515, 705, 9999, 9999, 9999, 1299]
    assert [r.c for r in rows] == [930, 2359, 1200, 1200, 1200, 1200, 1259]


def test_infer_date_cascade(spark):
    df = spark.createDataFrame([
        ("2001-12-24", None, None, None, None),  # full date
        (None, None, None, None, None),          # nothing -> as_of
        (None, None, None, None, 1),              # only weekday (Monday) -> as_of is a Monday
        (None, None, None, None, 5),              # only Friday -> 2001-10-05
        (None, None, 3, None, None),              # month already past -> next year, day 1
        (None, None, 11, None, 3),                # month + weekday -> first Wednesday of Nov
        (None, None, 10, 20, None),               # month + day
    ], "fd string, y int, m int, d int, w int")
    d = X.infer_date("2001-10-01", flight_date="fd", year="y", month="m", day="d", dow="w")
    got = [r[0] for r in df.select(d).collect()]
    assert got == [dt.date(2001, 12, 24), dt.date(2001, 10, 1), dt.date(2001, 10, 1), dt.date(2001, 10, 5),
                   dt.date(2002, 3, 1), dt.date(2001, 11, 7), dt.date(2001, 10, 20)]


def test_upcoming_window_paths(spark):
    df = spark.createDataFrame([(1, "2001-09-30"), (2, "2001-10-02"), (3, None), (4, "bad")], "id int, FLIGHT_DATE string")
    fut = B.upcoming_window(df, "2001-10-01")
    assert [r.id for r in fut.collect()] == [2] and fut.first().used_future
    none = B.upcoming_window(df, "2030-01-01")
    assert sorted(r.id for r in none.collect()) == [1, 2] and not none.first().used_future
    undated = spark.createDataFrame([(1, None)], "id int, FLIGHT_DATE string")
    assert B.upcoming_window(undated, "2001-10-01").count() == 1


def test_sample_rows_exact_size_and_determinism(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    a = B.sample_rows(df, 137, 42, ["k"])
    b = B.sample_rows(df.repartition(7), 137, 42, ["k"])
    assert a.count() == 137
    assert sorted(r.k for r in a.collect()) == sorted(r.k for r in b.collect())
    assert B.sample_rows(df, 10_000, 42, ["k"]).count() == 5000


def test_validate_rows(spark):
    df = spark.createDataFrame([(13, 8, " gru "), (5, 2, "  ")], "month int, day_of_week int, origin_airport string")
    rows = B.validate_rows(df).collect()
    assert rows[0].violations == ["month must be between 1 and 12", "day_of_week must be between 1 and 7"]
    assert rows[0].origin_airport == "GRU" and rows[1].origin_airport is None and rows[1].valid


def test_chat_text_helpers(spark):
    long = "x" * 1300
    df = spark.createDataFrame([("<think>a</think>  answer ",), ("plain ",), (long,)], "t string")
    rows = df.select(C.strip_reasoning("t").alias("s"), C.trim_text("t", 1200).alias("c")).collect()
    assert rows[0].s == "answer" and rows[1].s == "plain"
    assert rows[2].c == "x" * 1200 + "..."
    q = spark.createDataFrame([("Qual o risco de atraso?",), ("best price to Lisbon",), ("",)], "q string")
    got = q.select(C.wants_delay_assessment("q"), C.topic("q")).collect()
    assert [tuple(r) for r in got] == [(True, "timing"), (False, "price"), (False, "general")]
