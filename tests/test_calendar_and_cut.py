import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from skydelay.functions.calendar import is_holiday
from skydelay.operators.cut import kth_smallest_per_group
from skydelay.operators.ranking import keep_first, stratified_split


def test_holidays_match_pandas_calendar(spark):
    from pandas.tseries.holiday import USFederalHolidayCalendar
    expected = {d.date() for d in USFederalHolidayCalendar().holidays(start="1990-01-01", end="2035-12-31")}
    days = spark.sql("SELECT explode(sequence(DATE '1990-01-01', DATE '2035-12-31')) AS d")
    assert {r.d for r in days.where(is_holiday("d") == 1).collect()} == expected


def test_holidays_of_any_year(spark):
    days = [("1949-07-04", 1), ("1776-07-04", 1), ("2151-12-24", 1), ("2301-01-01", 1), ("2301-01-02", 0), ("1985-01-21", 0), (None, 0)]
    got = spark.createDataFrame(days, "d string, e int").select(is_holiday(F.to_date("d")).alias("h"), "e").collect()
    assert [r.h for r in got] == [r.e for r in got]


def test_kth_smallest_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["a", "b", "c", None]), f"{rnd.getrandbits(128):032x}") for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, h string")
    cut = kth_smallest_per_group(df, "h", ["g"], lambda n: F.floor(n * 0.7))
    got = {r["g"]: r["__cut"] for r in cut.collect()}
    w = Window.partitionBy("g").orderBy("h")
    ranked = df.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("g")))
    want = {r.g: r.h for r in ranked.where(F.col("rn") == F.floor(F.col("n") * 0.7)).collect()}
    assert got == want


def test_split_sizes_and_disjointness(spark):
    df = spark.range(0, 4000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    s = stratified_split(df, "y", 0.2, 42, ["k"])
    sizes = {(r.y, r.is_train): r["count"] for r in s.groupBy("y", "is_train").count().collect()}
    n1 = df.where("y = 1").count()
    n0 = 4000 - n1
    assert sizes[(1, True)] == int(n1 * 0.8) and sizes[(0, True)] == int(n0 * 0.8)
    assert s.select("k").distinct().count() == 4000


def test_keep_first_nulls_last_and_hot_key(spark):
    rows = [("hot", i % 50 if i else None, i) for i in range(5000)] + [("cold", 3, -1)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {r.k: (r.o, r.v) for r in keep_first(df, ["k"], [F.col("o"), F.col("v")]).collect()}
    assert got == {"hot": (0, 50), "cold": (3, -1)}


def test_exact_median_matches_brute_force(spark):
    import statistics

    from skydelay.operators.stats import exact_median
    for n, hi in ((1, 9), (2, 9), (1000, 50), (1001, 10**6)):
        rng = random.Random(n)
        vals = [float(rng.randint(0, hi)) + rng.random() * (hi > 100) for _ in range(n)] + [None]
        df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(3)
        got = spark.range(1).select(exact_median(df, "v", accuracy=100)).first()[0]
        assert got == statistics.median([v for v in vals if v is not None])


ODD_NUMBERS = ["1e300", "-1e300", "NaN", "Infinity", "1" * 24, "1" * 24 + ":30", "1234567890:30", "12:5", " 730 ", "abc", "", " ", "9.9e18",
               "-5", "2399", "1015.0", None]


def test_numbers_beyond_a_long_never_raise_and_both_forms_agree(spark):
    from skydelay.functions import exprs as X
    from skydelay.functions.register import register_functions
    register_functions(spark, "t_")
    df = spark.createDataFrame([(v,) for v in ODD_NUMBERS], "v string").withColumn("x", F.col("v").try_cast("double"))
    rows = df.select("v", X.format_hhmm("v").alias("f"), F.expr("t_format_hhmm(v)").alias("f2"), X.departure_sort_key("v").alias("k"),
                     F.expr("t_departure_sort_key(v)").alias("k2"), X.clamp_hhmm("x").alias("c"), F.expr("t_clamp_hhmm(x)").alias("c2"),
                     X.clamp_hhmm("v").alias("c3"), X.flight_number_text("v").alias("n"), X.dep_hour("x").alias("h"),
                     F.expr("t_is_delayed(x)").alias("d")).collect()
    got = {r["v"]: r for r in rows}
    assert all(r["f"] == r["f2"] and r["k"] == r["k2"] and r["c"] == r["c2"] for r in rows)
    assert [got[v]["k"] for v in ("1e300", "NaN", "Infinity", "1" * 24 + ":30", "1234567890:30", "12:5", None)] == \
        [9999, 9999, 9999, 9999, 123456789030, 1205, 9999]
    assert (got["1e300"]["f"], got["1e300"]["c3"], got["1e300"]["n"], got[" 730 "]["f"]) == ("1e300", 1200, "1e300", "07:30")


def test_dates_from_parts_and_holidays_of_every_day(spark):
    import datetime as dt
    from skydelay.functions import exprs as X
    from skydelay.functions.calendar import is_holiday
    parts = spark.createDataFrame([(y, m, d) for y in (0, 1, 1900, 2000, 2023, 2024, 9999, 10000) for m in range(0, 14) for d in range(0, 33)],
                                  "y int, m int, d int")
    for r in parts.select("*", X.ymd_date("y", "m", "d").alias("got")).collect():
        try:
            want = dt.date(r["y"], r["m"], r["d"])
        except ValueError:
            want = None
        assert r["got"] == want

    def observed(day):
        return day - dt.timedelta(1) if day.weekday() == 5 else day + dt.timedelta(1) if day.weekday() == 6 else day

    def nth(y, m, weekday, n):
        first = dt.date(y, m, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    want = set()
    for y in range(1979, 2032):
        want |= {observed(dt.date(y, m, d)) for m, d in ((1, 1), (7, 4), (11, 11), (12, 25))} | ({observed(dt.date(y, 6, 19))} if y >= 2021 else set())
        want |= {nth(y, 2, 0, 3), nth(y, 9, 0, 1), nth(y, 10, 0, 2), nth(y, 11, 3, 4)} | ({nth(y, 1, 0, 3)} if y >= 1986 else set())
        may = nth(y, 5, 0, 4)
        want.add(may + dt.timedelta(7) if (may + dt.timedelta(7)).month == 5 else may)
    days = spark.sql("SELECT explode(sequence(DATE '1980-01-01', DATE '2030-12-31')) AS d")
    got = {r["d"] for r in days.where(is_holiday("d") == 1).collect()}
    assert got == {d for d in want if 1980 <= d.year <= 2030}
