"""Faults found in round 3: the rate tables read their input once; stages too large to be compiled are split."""

from skydelay.operators import stats as D
from skydelay.plans import requests as Q
from skydelay.plans.registry import REGISTRY


def test_rate_tables_aggregate_in_one_pass(spark):
    rows = [("A", "B", "X", "A-B", "X_1", 1), ("A", None, "X", None, "X_1", 0), ("B", "A", None, "B-A", None, 1)]
    df = spark.createDataFrame(rows, "ORIGIN_AIRPORT string, DESTINATION_AIRPORT string, AIRLINE string, ROUTE string, AIRLINE_DOW string, IS_DELAYED int")
    rates = D.rate_tables(df, include_global=True)
    assert rates._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 1
    got = {(r["rate"], r["key"]): (round(r["value"], 6), r["n"]) for r in rates.collect()}
    assert got == {("ORIGIN_DELAY_RATE", "A"): (0.5, 2), ("ORIGIN_DELAY_RATE", "B"): (1.0, 1), ("DEST_DELAY_RATE", "B"): (1.0, 1),
                   ("DEST_DELAY_RATE", "A"): (1.0, 1), ("CARRIER_DELAY_RATE", "X"): (0.5, 2), ("ROUTE_DELAY_RATE", "A-B"): (1.0, 1),
                   ("ROUTE_DELAY_RATE", "B-A"): (1.0, 1), ("CARRIER_DELAY_RATE_DOW", "X_1"): (0.5, 2), (D.GLOBAL_RATE, None): (round(2 / 3, 6), 3)}


def test_stages_are_small_enough_to_be_compiled(spark):
    from conftest import SF_SMALL
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    REGISTRY["B1_clean_flights"][0](spark, SF_SMALL)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_the_cube_stays_by_route(spark):
    """Flights under every mask are joined, summed and ranked where their route is: no shuffle holds them."""
    schedule = spark.createDataFrame([(2024, 1, d, 1 + d % 7, a, str(d), t, "A", "B", d / 100) for d in range(1, 29) for a in ("X", None) for t in (700, 930)],
                                     "YEAR int, MONTH int, DAY int, DAY_OF_WEEK int, AIRLINE string, FLIGHT_NUMBER string, SCHEDULED_DEPARTURE int, "
                                     "ORIGIN_AIRPORT string, DESTINATION_AIRPORT string, delay_probability double")
    asked = [(1, "A", "B", "x", 700, None, 1, None), (2, "a", "b", None, None, 3, None, None), (3, "A", "B", "X", None, None, None, "2024-01-09"),
             (3, "A", "B", None, None, None, None, None), (3, "A", "C", None, None, None, None, None), (4, "A", "B", "Z", None, None, None, None)]
    req = spark.createDataFrame(asked, "request_id long, origin_airport string, destination_airport string, airline string, scheduled_departure int, "
                                       "day_of_week int, month int, flight_date string")
    summary, best = Q.weekly_route_estimate(req, schedule, "2024-01-10")
    other = Q.suggest_for_requests(req, schedule)
    for df, by_id in ((summary, 0), (best, 0), (other, 2)):
        exchanges = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
        assert exchanges and sum("REPARTITION_BY_NUM" not in x for x in exchanges) <= by_id
    got = sorted((r["request_id"], r["flights"], round(r["mean_probability"], 6)) for r in summary.collect())
    assert got == [(1, 19, 0.19), (2, 8, 0.195), (3, 2, 0.09), (3, 28, 0.13)]
    tops = sorted((r["request_id"], r["rank"], r["_flight_date"].day, r["AIRLINE"]) for r in best.collect())
    assert [t for t in tops if t[0] == 1] == [(1, 1, 10, "X"), (1, 2, 11, "X"), (1, 3, 12, "X")]
    first = sorted((r["request_id"], r["rank"], r["attempt"], r["_flight_date"].day, r["AIRLINE"], r["SCHEDULED_DEPARTURE"]) for r in other.collect())
    assert [t for t in first if t[0] == 1] == [(1, 1, 0, 1, "X", "09:30"), (1, 2, 0, 1, None, "07:00"), (1, 3, 0, 1, None, "09:30")]
    assert [t[1] for t in first if t[0] == 3] == [1, 2, 3]  # one id, several rows
