"""Registered queries: one per operator of the survey inventory, each run over the whole test tables.

Each entry has a Spark callable ``(spark, sf_dir) -> DataFrame`` built from the library's operators, and (where the
result can be written in SQL) a DuckDB oracle over the same parquet tables. Column names match between the two.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skydelay.operators import joins as J
from skydelay.operators import ranking as R
from skydelay.operators import rows as B
from skydelay.operators import stats as D
from skydelay.plans import fixtures as FX
from skydelay.plans import jobs
from skydelay.plans.oracle_ctes import with_ctes
from skydelay.session import compiled_methods_only

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            compiled_methods_only(spark)
            return fn(spark, sf)
        REGISTRY[name] = (run, with_ctes(list(needs), sql) if sql else None)
        return fn
    return deco


def V(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return FX.view(spark, sf, name)


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.enrich(V(spark, sf, "flights"), V(spark, sf, "airports_raw"), V(spark, sf, "airlines"))


def slim(spark: SparkSession, sf: str) -> DataFrame:
    return B.dashboard_slim(enriched(spark, sf))


def pre(spark: SparkSession, sf: str) -> jobs.Preprocessed:
    return jobs.preprocess(V(spark, sf, "flights"), V(spark, sf, "airports_raw"), V(spark, sf, "airlines"))


# ---------------------------------------------------------------------------------------------- B
@query("B1_clean_flights", f"""
SELECT {KEYS_SQL}, ARRIVAL_DELAY, CANCELLED FROM flights
WHERE CANCELLED IS DISTINCT FROM 1 AND ARRIVAL_DELAY IS NOT NULL AND ARRIVAL_DELAY <= 500""", ("flights",))
def q_b1(spark, sf):
    return B.clean_flights(V(spark, sf, "flights")).select(*KEYS, "ARRIVAL_DELAY", "CANCELLED")


@query("B2_cleaning_report", """
SELECT (SELECT count(*) FROM flights) AS rows_in, count(*) AS rows_out, (SELECT count(*) FROM flights) - count(*) AS removed,
  count(*) FILTER (WHERE floor(COALESCE(SCHEDULED_DEPARTURE, 0) / 100) > 23) AS invalid_hour_rows
FROM flights WHERE CANCELLED IS DISTINCT FROM 1 AND ARRIVAL_DELAY IS NOT NULL AND ARRIVAL_DELAY <= 500""", ("flights",))
def q_b2(spark, sf):
    f = V(spark, sf, "flights")
    return B.cleaning_report(f, B.clean_flights(f))


DASH_FILTER = dict(years=(1995, 1996), airlines=("Air Brand#11", "Air Brand#22", "Air Brand#33", "Brand#44"))
DASH_WHERE = "year IN (1995, 1996) AND COALESCE(airline_name, airline) IN ('Air Brand#11', 'Air Brand#22', 'Air Brand#33', 'Brand#44')"


@query("B4_dashboard_filter", """
SELECT * FROM slim WHERE month IN (1, 2, 3) AND origin_state IN ('S1', 'S2')""", ("slim",))
def q_b4(spark, sf):
    return B.dashboard_filter(slim(spark, sf), months=(1, 2, 3), states=("S1", "S2"))


@query("B6_default_selection", "SELECT DISTINCT year AS value FROM slim WHERE year IN (1995, 1997, 2099)", ("slim",))
def q_b6(spark, sf):
    years = slim(spark, sf).select(F.col("year").alias("value")).where(F.col("value").isNotNull()).distinct()
    return B.default_selection(years, (1995, 1997, 2099))


@query("B6_default_selection_latest", "SELECT max(year) AS value FROM slim", ("slim",))
def q_b6b(spark, sf):
    years = slim(spark, sf).select(F.col("year").alias("value")).where(F.col("value").isNotNull()).distinct()
    return B.default_selection(years, ())


@query("B9_drop_incomplete", """
SELECT * FROM slim WHERE arrival_delay IS NOT NULL AND is_delayed IS NOT NULL AND month IS NOT NULL
  AND airline_name IS NOT NULL""", ("slim",))
def q_b9(spark, sf):
    return B.drop_incomplete(slim(spark, sf), ["arrival_delay", "is_delayed", "month", "airline_name", "not_a_column"])


@query("B11_dashboard_slim", "SELECT * FROM slim", ("slim",))
def q_b11(spark, sf):
    return slim(spark, sf)


# ---------------------------------------------------------------------------------------------- C
@query("C1_join_airline", f"""
SELECT {KEYS_SQL}, f.AIRLINE, a.AIRLINE AS AIRLINE_NAME FROM flights f LEFT JOIN airlines a ON f.AIRLINE = a.IATA_CODE""",
       ("flights", "airlines"))
def q_c1(spark, sf):
    return J.join_airline(V(spark, sf, "flights"), V(spark, sf, "airlines")).select(*KEYS, "AIRLINE", "AIRLINE_NAME")


@query("C2_join_airports", f"""
SELECT {KEYS_SQL}, o.AIRPORT AS ORIGIN_AIRPORT_NAME, o.CITY AS ORIGIN_CITY, o.STATE AS ORIGIN_STATE,
  o.LATITUDE AS ORIGIN_LATITUDE, o.LONGITUDE AS ORIGIN_LONGITUDE, d.AIRPORT AS DESTINATION_AIRPORT_NAME,
  d.CITY AS DESTINATION_CITY, d.STATE AS DESTINATION_STATE, d.LATITUDE AS DESTINATION_LATITUDE,
  d.LONGITUDE AS DESTINATION_LONGITUDE
FROM flights f LEFT JOIN airports_raw o ON f.ORIGIN_AIRPORT = o.IATA_CODE
LEFT JOIN airports_raw d ON f.DESTINATION_AIRPORT = d.IATA_CODE""", ("flights", "airports_raw"))
def q_c2(spark, sf):
    out = J.join_airports(V(spark, sf, "flights"), V(spark, sf, "airports_raw"))
    return out.select(*KEYS, *[f"{s}_{c}" for s in ("ORIGIN", "DESTINATION") for c in J.AIRPORT_ATTRS.values()])


@query("C3_airport_profiles", """
SELECT a.IATA_CODE, a.AIRPORT, a.CITY, a.STATE, a.COUNTRY, a.LATITUDE, a.LONGITUDE,
  o.origin_flights, o.origin_delay_rate, o.origin_avg_arrival_delay, o.origin_avg_weather_delay,
  o.origin_avg_late_aircraft_delay, d.dest_flights, d.dest_delay_rate, d.dest_avg_arrival_delay
FROM airports_raw a
LEFT JOIN (SELECT ORIGIN_AIRPORT, count(ROUTE) AS origin_flights, avg(IS_DELAYED) AS origin_delay_rate,
             avg(ARRIVAL_DELAY) AS origin_avg_arrival_delay, avg(WEATHER_DELAY) AS origin_avg_weather_delay,
             avg(LATE_AIRCRAFT_DELAY) AS origin_avg_late_aircraft_delay
           FROM enriched WHERE ORIGIN_AIRPORT IS NOT NULL GROUP BY 1) o ON a.IATA_CODE = o.ORIGIN_AIRPORT
LEFT JOIN (SELECT DESTINATION_AIRPORT, count(ROUTE) AS dest_flights, avg(IS_DELAYED) AS dest_delay_rate,
             avg(ARRIVAL_DELAY) AS dest_avg_arrival_delay
           FROM enriched WHERE DESTINATION_AIRPORT IS NOT NULL GROUP BY 1) d ON a.IATA_CODE = d.DESTINATION_AIRPORT""",
       ("enriched", "airports_raw"))
def q_c3(spark, sf):
    return J.airport_profiles(enriched(spark, sf), V(spark, sf, "airports_raw"))


@query("C4_apply_rates", f"""
SELECT {KEYS_SQL}, ORIGIN_DELAY_RATE, DEST_DELAY_RATE, CARRIER_DELAY_RATE, ROUTE_DELAY_RATE, CARRIER_DELAY_RATE_DOW
FROM processed WHERE NOT is_train""", ("processed",))
def q_c4(spark, sf):
    return pre(spark, sf).test.select(*KEYS, *J.RATE_KEYS)


# ---------------------------------------------------------------------------------------------- D
@query("D1_global_rate", "SELECT avg(IS_DELAYED) AS global_rate FROM enriched", ("enriched",))
def q_d1(spark, sf):
    return D.global_rate(enriched(spark, sf))


@query("D2_rate_tables", "SELECT * FROM rates", ("rates",))
def q_d2(spark, sf):
    return pre(spark, sf).rates


@query("D3_route_distance", """
SELECT ROUTE, avg(DISTANCE) AS mean_distance, false AS is_overall FROM enriched WHERE ROUTE IS NOT NULL GROUP BY ROUTE
UNION ALL SELECT NULL, avg(DISTANCE), true FROM enriched""", ("enriched",))
def q_d3(spark, sf):
    return D.route_distance(enriched(spark, sf))


@query("D4_origin_stats", """
SELECT ORIGIN_AIRPORT, count(ROUTE) AS origin_flights, avg(IS_DELAYED) AS origin_delay_rate,
  avg(ARRIVAL_DELAY) AS origin_avg_arrival_delay, avg(WEATHER_DELAY) AS origin_avg_weather_delay,
  avg(LATE_AIRCRAFT_DELAY) AS origin_avg_late_aircraft_delay
FROM enriched WHERE ORIGIN_AIRPORT IS NOT NULL GROUP BY 1""", ("enriched",))
def q_d4(spark, sf):
    return D.origin_stats(enriched(spark, sf))


@query("D5_destination_stats", """
SELECT DESTINATION_AIRPORT, count(ROUTE) AS dest_flights, avg(IS_DELAYED) AS dest_delay_rate,
  avg(ARRIVAL_DELAY) AS dest_avg_arrival_delay
FROM enriched WHERE DESTINATION_AIRPORT IS NOT NULL GROUP BY 1""", ("enriched",))
def q_d5(spark, sf):
    return D.destination_stats(enriched(spark, sf))


@query("D6_dashboard_kpis", f"""
SELECT count(*) AS total_flights, avg(CASE WHEN is_delayed = 1 THEN 1.0E0 ELSE 0.0E0 END) AS delay_rate,
  avg(arrival_delay) AS avg_delay FROM slim WHERE {DASH_WHERE}""", ("slim",))
def q_d6(spark, sf):
    return D.dashboard_kpis(B.dashboard_filter(slim(spark, sf), **DASH_FILTER))


@query("D7_worst_airline", """
SELECT airline, avg_delay FROM (SELECT COALESCE(airline_name, airline) AS airline, avg(arrival_delay) AS avg_delay
  FROM slim GROUP BY 1) t ORDER BY avg_delay DESC, airline LIMIT 1""", ("slim",))
def q_d7(spark, sf):
    return D.worst_airline(slim(spark, sf))


@query("D8_delay_by_month", f"""
SELECT month, avg(arrival_delay) AS avg_delay FROM slim WHERE {DASH_WHERE} GROUP BY month""", ("slim",))
def q_d8(spark, sf):
    return D.delay_by_month(B.dashboard_filter(slim(spark, sf), **DASH_FILTER))


@query("D9_filter_options", """
SELECT DISTINCT 'year' AS dim, CAST(year AS VARCHAR) AS value FROM slim WHERE year IS NOT NULL
UNION ALL SELECT DISTINCT 'month', CAST(month AS VARCHAR) FROM slim WHERE month IS NOT NULL
UNION ALL SELECT DISTINCT 'airline', COALESCE(airline_name, airline) FROM slim WHERE airline IS NOT NULL
UNION ALL SELECT DISTINCT 'state', origin_state FROM slim WHERE origin_state IS NOT NULL""", ("slim",))
def q_d9(spark, sf):
    return D.filter_options(slim(spark, sf))


# ---------------------------------------------------------------------------------------------- E / F
@query("E1_stratified_split", f"SELECT {KEYS_SQL}, IS_DELAYED, is_train FROM split", ("split",))
def q_e1(spark, sf):
    return R.stratified_split(enriched(spark, sf), "IS_DELAYED", 0.2, 42, KEYS).select(*KEYS, "IS_DELAYED", "is_train")


@query("F1_delay_by_airline", """
SELECT COALESCE(airline_name, airline) AS airline, avg(arrival_delay) AS avg_delay FROM slim
GROUP BY 1 ORDER BY avg_delay DESC NULLS LAST, airline LIMIT 20""", ("slim",))
def q_f1(spark, sf):
    return R.delay_by_airline(slim(spark, sf), 20)


# ---------------------------------------------------------------------------------------------- H / I
@query("H31_engineer_features", f"""
SELECT {KEYS_SQL}, TIME_OF_DAY, SEASON, IS_HOLIDAY, ROUTE, AIRLINE_DOW, IS_DELAYED FROM enriched""", ("enriched",))
def q_h31(spark, sf):
    return enriched(spark, sf).select(*KEYS, "TIME_OF_DAY", "SEASON", "IS_HOLIDAY", "ROUTE", "AIRLINE_DOW", "IS_DELAYED")


@query("H5_is_holiday", "SELECT DISTINCT YEAR, MONTH, DAY, IS_HOLIDAY FROM enriched", ("enriched",))
def q_h5(spark, sf):
    return enriched(spark, sf).select("YEAR", "MONTH", "DAY", "IS_HOLIDAY").distinct()


@query("I15_flights_processed", f"""
SELECT {KEYS_SQL}, YEAR, AIRLINE_NAME, ORIGIN_CITY, DESTINATION_STATE, TIME_OF_DAY, SEASON, IS_HOLIDAY, ROUTE,
  IS_DELAYED, AIRLINE_DOW, ORIGIN_DELAY_RATE, DEST_DELAY_RATE, CARRIER_DELAY_RATE, ROUTE_DELAY_RATE, CARRIER_DELAY_RATE_DOW
FROM processed""", ("processed",))
def q_i15(spark, sf):
    return pre(spark, sf).flights_processed.select(
        *KEYS, "YEAR", "AIRLINE_NAME", "ORIGIN_CITY", "DESTINATION_STATE", "TIME_OF_DAY", "SEASON", "IS_HOLIDAY", "ROUTE",
        "IS_DELAYED", "AIRLINE_DOW", *J.RATE_KEYS)


@query("I15_train", f"""
SELECT {KEYS_SQL}, IS_DELAYED, ORIGIN_DELAY_RATE, DEST_DELAY_RATE, CARRIER_DELAY_RATE, ROUTE_DELAY_RATE,
  CARRIER_DELAY_RATE_DOW FROM processed WHERE is_train""", ("processed",))
def q_i15_train(spark, sf):
    return pre(spark, sf).train.select(*KEYS, "IS_DELAYED", *J.RATE_KEYS)


@query("I15_airport_profiles", """
SELECT a.IATA_CODE, o.origin_flights, d.dest_flights FROM airports_raw a
LEFT JOIN (SELECT ORIGIN_AIRPORT, count(ROUTE) AS origin_flights FROM enriched GROUP BY 1) o ON a.IATA_CODE = o.ORIGIN_AIRPORT
LEFT JOIN (SELECT DESTINATION_AIRPORT, count(ROUTE) AS dest_flights FROM enriched GROUP BY 1) d
  ON a.IATA_CODE = d.DESTINATION_AIRPORT""", ("enriched", "airports_raw"))
def q_i15_profiles(spark, sf):
    return pre(spark, sf).airport_profiles.select("IATA_CODE", "origin_flights", "dest_flights")
