"""Registered queries: schedules, validation, risk ranking and the scalar expressions (survey B, C, D, E, F, H, I).

``scored`` carries a deterministic stand-in for a model probability so the ranking and metric operators have exact
oracles; the Spark ML path is registered separately (rows-only check plus pytest).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skydelay.functions import exprs as X
from skydelay.operators import joins as J
from skydelay.operators import ranking as R
from skydelay.operators import rows as B
from skydelay.operators import stats as D
from skydelay.plans.fixtures import AS_OF_FUTURE, AS_OF_NONE
from skydelay.plans.queries import KEYS, KEYS_SQL, V, enriched, pre, query, slim

WEEK_START = "2001-10-08"  # the Monday after AS_OF_FUTURE


def airports_idx(spark, sf):
    return B.normalize_airports(V(spark, sf, "airports_raw"), order_col="src_order")


def scored_dated(spark, sf):
    return V(spark, sf, "scored")


def fmt_hhmm_sql(c: str) -> str:
    v = f"LEAST(GREATEST(CAST({c} AS BIGINT), 0), 2359)"
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE printf('%02d:%02d', {v} // 100, LEAST({v} % 100, 59)) END"


def window_sql(src: str, as_of: str, days: int | None = None) -> str:
    """DuckDB form of the upcoming window (B8) over a CTE ``src`` that has a DATE column fd."""
    d = f"DATE '{as_of}'"
    body = f"""(SELECT *, (SELECT count(*) FILTER (WHERE fd >= {d}) > 0 FROM {src}) AS used_future FROM {src}
  WHERE CASE WHEN (SELECT count(fd) FROM {src}) = 0 THEN true
             WHEN (SELECT count(*) FILTER (WHERE fd >= {d}) FROM {src}) > 0 THEN fd >= {d} ELSE fd IS NOT NULL END)"""
    if days:
        cap = f"({d} + {int(days) - 1})"
        body = f"""(SELECT * FROM {body} w0 WHERE (SELECT count(*) FILTER (WHERE fd <= {cap}) FROM {body} w1) = 0
  OR fd <= {cap})"""
    return body


SC = "sc AS (SELECT *, make_date(YEAR, MONTH, DAY) AS fd FROM scored)"


# ---------------------------------------------------------------------------------------------- B
@query("B3_filter_flights", f"""
SELECT {KEYS_SQL}, ORIGIN_AIRPORT, AIRLINE, MONTH FROM flights
WHERE upper(trim(ORIGIN_AIRPORT)) = 'N05' AND upper(trim(AIRLINE)) = 'BRAND#13' AND MONTH = 6""", ("flights",))
def q_b3(spark, sf):
    return B.filter_flights(V(spark, sf, "flights"), origin=" n05 ", airline="brand#13", month=6) \
        .select(*KEYS, "ORIGIN_AIRPORT", "AIRLINE", "MONTH")


@query("B3_filter_flights_date", f"""
SELECT {KEYS_SQL} FROM flights WHERE YEAR = 1998 AND MONTH = 6 AND DAY = 15 AND DAY_OF_WEEK = 1""", ("flights",))
def q_b3d(spark, sf):
    return B.filter_flights(V(spark, sf, "flights"), flight_date="1998-06-15", dow=1).select(*KEYS)


@query("B7_filter_week", """
SELECT request_id, flight_date FROM requests
WHERE try_cast(flight_date AS DATE) >= DATE '1998-06-01' AND try_cast(flight_date AS DATE) < DATE '1998-06-29'""",
       ("requests",))
def q_b7(spark, sf):
    return B.filter_week(V(spark, sf, "requests"), "1998-06-01", 28, "flight_date").select("request_id", "flight_date")


@query("B8_upcoming_window", f"""
WITH {SC} SELECT {KEYS_SQL}, strftime(fd, '%Y-%m-%d') AS flight_date, used_future FROM {window_sql('sc', AS_OF_FUTURE)} w""",
       ("scored",))
def q_b8(spark, sf):
    w = B.upcoming_window(V(spark, sf, "scored"), AS_OF_FUTURE)
    return w.select(*KEYS, F.date_format("_flight_date", "yyyy-MM-dd").alias("flight_date"), "used_future")


@query("B8_upcoming_window_fallback", f"""
WITH {SC} SELECT {KEYS_SQL}, strftime(fd, '%Y-%m-%d') AS flight_date, used_future FROM {window_sql('sc', AS_OF_NONE)} w""",
       ("scored",))
def q_b8b(spark, sf):
    w = B.upcoming_window(V(spark, sf, "scored"), AS_OF_NONE)
    return w.select(*KEYS, F.date_format("_flight_date", "yyyy-MM-dd").alias("flight_date"), "used_future")


@query("B8_upcoming_window_capped", f"""
WITH {SC} SELECT {KEYS_SQL}, strftime(fd, '%Y-%m-%d') AS flight_date, used_future
FROM {window_sql('sc', AS_OF_FUTURE, 7)} w""", ("scored",))
def q_b8c(spark, sf):
    w = B.upcoming_window(V(spark, sf, "scored"), AS_OF_FUTURE, days=7)
    return w.select(*KEYS, F.date_format("_flight_date", "yyyy-MM-dd").alias("flight_date"), "used_future")


HASH_SQL = ("md5('42|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|' "
            "|| CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)")


@query("B21_sample_rows", f"SELECT {KEYS_SQL}, ARRIVAL_DELAY FROM flights ORDER BY {HASH_SQL}) LIMIT 500", ("flights",))
def q_b21(spark, sf):
    return B.sample_rows(V(spark, sf, "flights"), 500, 42, KEYS).select(*KEYS, "ARRIVAL_DELAY")


def _assign_sql(start: str, days: int, src: str = "flights") -> str:
    off = f"CAST((('0x' || substr({HASH_SQL} || '|date'), 1, 8))::BIGINT % {days}) AS INTEGER)"
    return f"""SELECT {KEYS_SQL}, CAST(year(d) AS INTEGER) AS YEAR, CAST(month(d) AS INTEGER) AS MONTH, CAST(day(d) AS INTEGER) AS DAY,
  CAST(isodow(d) AS INTEGER) AS DAY_OF_WEEK,
  strftime(d, '%Y-%m-%d') AS FLIGHT_DATE FROM (SELECT *, DATE '{start}' + {off} AS d FROM {src}) t"""


@query("B22_assign_future_dates", _assign_sql(WEEK_START, 7), ("flights",))
def q_b22(spark, sf):
    out = B.assign_future_dates(V(spark, sf, "flights"), WEEK_START, 7, 42, KEYS)
    return out.select(*KEYS, "YEAR", "MONTH", "DAY", "DAY_OF_WEEK", "FLIGHT_DATE")


@query("B23_exclude_requested", f"""
SELECT {KEYS_SQL} FROM flights WHERE NOT (upper(trim(AIRLINE)) IS NOT DISTINCT FROM 'BRAND#13'
  AND CAST(SCHEDULED_DEPARTURE AS DOUBLE) IS NOT DISTINCT FROM 1015.0)""", ("flights",))
def q_b23(spark, sf):
    return B.exclude_requested(V(spark, sf, "flights"), "Brand#13", 1015).select(*KEYS)


@query("B24_generate_future_schedule", f"""
WITH smp AS (SELECT * FROM flights ORDER BY {HASH_SQL}) LIMIT 2000)
SELECT s.{KEYS_SQL.replace(', ', ', s.')}, s.SCHEDULED_DEPARTURE, s.DISTANCE, s.ORIGIN_AIRPORT, s.DESTINATION_AIRPORT,
  s.AIRLINE, a.YEAR, a.MONTH, a.DAY, a.DAY_OF_WEEK, a.FLIGHT_DATE
FROM smp s JOIN ({_assign_sql(WEEK_START, 7, 'smp')}) a USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)""",
       ("flights",))
def q_b24(spark, sf):
    return B.generate_future_schedule(V(spark, sf, "flights"), 2000, 42, KEYS, days=7, as_of=AS_OF_FUTURE)


@query("B12_coerce_to_schema", f"""
SELECT {KEYS_SQL}, CAST(round_even(ARRIVAL_DELAY / 3, 0) AS INTEGER) AS ARRIVAL_DELAY,
  CAST(SCHEDULED_DEPARTURE AS DOUBLE) AS SCHEDULED_DEPARTURE, CAST(FLIGHT_NUMBER AS VARCHAR) AS FLIGHT_NUMBER
FROM flights""", ("flights",))
def q_b12(spark, sf):
    f = V(spark, sf, "flights").withColumn("ARRIVAL_DELAY", F.col("ARRIVAL_DELAY") / 3)
    out = B.coerce_to_schema(f, [("ARRIVAL_DELAY", "INT"), ("SCHEDULED_DEPARTURE", "DOUBLE"),
                                 ("FLIGHT_NUMBER", "STRING"), ("NOT_THERE", "INT")])
    return out.select(*KEYS, "ARRIVAL_DELAY", "SCHEDULED_DEPARTURE", "FLIGHT_NUMBER")


@query("B13_coerce_features", f"""
SELECT {KEYS_SQL}, CAST(SCHEDULED_DEPARTURE AS DOUBLE) AS SCHEDULED_DEPARTURE, COALESCE(DESTINATION_AIRPORT, 'nan')
  AS DESTINATION_AIRPORT FROM flights""", ("flights",))
def q_b13(spark, sf):
    out = B.coerce_features(V(spark, sf, "flights"), ["SCHEDULED_DEPARTURE"], ["DESTINATION_AIRPORT"])
    return out.select(*KEYS, "SCHEDULED_DEPARTURE", "DESTINATION_AIRPORT")


@query("B14_validate_rows", """
SELECT request_id, upper(NULLIF(trim(origin_airport), '')) AS origin_airport, upper(NULLIF(trim(airline), '')) AS airline,
  array_to_string(list_filter([
    CASE WHEN month IS NOT NULL AND NOT (month BETWEEN 1 AND 12) THEN 'month must be between 1 and 12' END,
    CASE WHEN day_of_week IS NOT NULL AND NOT (day_of_week BETWEEN 1 AND 7) THEN 'day_of_week must be between 1 and 7' END,
    CASE WHEN day IS NOT NULL AND NOT (day BETWEEN 1 AND 31) THEN 'day must be between 1 and 31' END,
    CASE WHEN year IS NOT NULL AND NOT (year BETWEEN 2000 AND 2100) THEN 'year must be between 2000 and 2100' END,
    CASE WHEN scheduled_departure IS NOT NULL AND NOT (scheduled_departure BETWEEN 0 AND 2359)
      THEN 'scheduled_departure must be between 0 and 2359' END], lambda x: x IS NOT NULL), ';') AS violations,
  (month IS NULL OR month BETWEEN 1 AND 12) AND (day_of_week IS NULL OR day_of_week BETWEEN 1 AND 7)
    AND (day IS NULL OR day BETWEEN 1 AND 31) AND (year IS NULL OR year BETWEEN 2000 AND 2100) AND (scheduled_departure IS NULL OR scheduled_departure BETWEEN 0 AND 2359) AS valid
FROM requests""", ("requests",))
def q_b14(spark, sf):
    out = B.validate_rows(V(spark, sf, "requests"))
    return out.select("request_id", "origin_airport", "airline", F.array_join("violations", ";").alias("violations"), "valid")


@query("B15_normalize_airports", "SELECT * FROM airports_idx", ("airports_idx",))
def q_b15(spark, sf):
    return airports_idx(spark, sf)


@query("B16_prediction_partition_frame", """
SELECT AIRLINE, FLIGHT_NUMBER, YEAR AS year, MONTH AS month FROM predictions WHERE YEAR IS NOT NULL AND MONTH IS NOT NULL""",
       ("predictions",))
def q_b16(spark, sf):
    return B.prediction_partition_frame(V(spark, sf, "predictions")).select("AIRLINE", "FLIGHT_NUMBER", "year", "month")


# ---------------------------------------------------------------------------------------------- C
MATCH_SQL = """
SELECT p.*, a.IS_DELAYED AS actual_is_delayed, a.ARRIVAL_DELAY AS actual_arrival_delay FROM predictions p
JOIN actuals a ON p.YEAR = a.YEAR AND p.MONTH = a.MONTH AND p.DAY = a.DAY AND p.AIRLINE = a.AIRLINE
  AND p.ORIGIN_AIRPORT = a.ORIGIN_AIRPORT AND p.DESTINATION_AIRPORT = a.DESTINATION_AIRPORT
  AND p.FLIGHT_NUMBER = a.FLIGHT_NUMBER"""


def matched(spark, sf):
    return J.match_actuals(V(spark, sf, "predictions"), V(spark, sf, "actuals"))


@query("C5_match_actuals", MATCH_SQL, ("predictions", "actuals"))
def q_c5(spark, sf):
    return matched(spark, sf)


@query("C6_lookup_airport", f"""
SELECT {KEYS_SQL}, i.country AS origin_country, i.city AS origin_city, i.airport_name AS origin_airport_name,
  CASE WHEN i.city IS NOT NULL AND i.country IS NOT NULL THEN i.city || ', ' || i.country
       ELSE COALESCE(i.city, i.country, i.airport_name) END AS origin_label
FROM flights f LEFT JOIN airports_idx i ON upper(trim(f.ORIGIN_AIRPORT)) = i.iata_code""", ("flights", "airports_idx"))
def q_c6(spark, sf):
    out = J.lookup_airport(V(spark, sf, "flights"), airports_idx(spark, sf), "ORIGIN_AIRPORT", "origin")
    return out.select(*KEYS, "origin_country", "origin_city", "origin_airport_name", "origin_label")


@query("C7_hour_grid", """
SELECT request_id, CAST(COALESCE(scheduled_departure, s * 100) AS INTEGER) AS slot_departure
FROM requests, range(0, 24) r(s) WHERE scheduled_departure IS NULL OR s = 0""", ("requests",))
def q_c7(spark, sf):
    return J.hour_grid(V(spark, sf, "requests"), "scheduled_departure").select("request_id", "slot_departure")


# ---------------------------------------------------------------------------------------------- D
D11_SQL = f"""
WITH m AS ({MATCH_SQL}), c AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE delay_prediction = 1 AND actual_is_delayed = 1) AS tp,
    count(*) FILTER (WHERE delay_prediction = 0 AND actual_is_delayed = 0) AS tn,
    count(*) FILTER (WHERE delay_prediction = 1 AND actual_is_delayed = 0) AS fp,
    count(*) FILTER (WHERE delay_prediction = 0 AND actual_is_delayed = 1) AS fn,
    avg((delay_probability - actual_is_delayed) ^ 2) AS brier, avg(actual_is_delayed) AS ay, avg(delay_prediction) AS ap
  FROM m), r AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0E0 END AS prec,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0E0 END AS rec FROM c)
SELECT n AS total_matched, round_even(CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0.0E0 END, 4) AS accuracy,
  round_even(prec, 4) AS precision, round_even(rec, 4) AS recall,
  round_even(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0E0 END, 4) AS f1_score,
  round_even(brier, 4) AS brier_score, tp AS true_positives, tn AS true_negatives, fp AS false_positives,
  fn AS false_negatives, round_even(ay, 4) AS actual_delay_rate, round_even(ap, 4) AS pred_delay_rate FROM r"""


@query("D11_classification_report", D11_SQL, ("predictions", "actuals"))
def q_d11(spark, sf):
    return D.classification_report(matched(spark, sf))


D12_SQL = f"""
WITH m AS ({MATCH_SQL}), h AS (
  SELECT delay_probability AS s, count(*) FILTER (WHERE actual_is_delayed = 1) AS pos,
    count(*) FILTER (WHERE actual_is_delayed = 0) AS neg FROM m GROUP BY 1),
c AS (SELECT *, COALESCE(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h)
SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN CAST(sum(pos * (2 * below + neg)) AS DOUBLE)
  / (2 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS roc_auc,
  CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM c"""


@query("D12_roc_auc", D12_SQL, ("predictions", "actuals"))
def q_d12(spark, sf):
    return D.roc_auc(matched(spark, sf))


@query("D13_class_balance", """
SELECT IS_DELAYED AS class, count(*) AS count, (SELECT count(*) FROM enriched) / (2.0E0 * count(*)) AS balanced_weight,
  CAST(GREATEST((SELECT count(*) FROM enriched WHERE IS_DELAYED = 0), 1) AS DOUBLE)
    / GREATEST((SELECT count(*) FROM enriched WHERE IS_DELAYED = 1), 1) AS neg_pos_ratio
FROM enriched GROUP BY 1""", ("enriched",))
def q_d13(spark, sf):
    return D.class_balance(enriched(spark, sf))


@query("D14_route_risk", """
SELECT ORIGIN_AIRPORT, DESTINATION_AIRPORT,
  CAST(sum(CAST(delay_probability AS DECIMAL(30,6))) AS DOUBLE) / count(delay_probability) AS mean_probability,
  count(*) AS flights FROM scored GROUP BY 1, 2""", ("scored",))
def q_d14(spark, sf):
    return D.route_risk(V(spark, sf, "scored"), decimals=6).drop("risk_level")


@query("D14_route_risk_level", """
SELECT ORIGIN_AIRPORT, DESTINATION_AIRPORT, CASE WHEN m >= 0.7 THEN 'HIGH' WHEN m >= 0.4 THEN 'MEDIUM'
  WHEN m IS NOT NULL THEN 'LOW' END AS risk_level FROM (
  SELECT ORIGIN_AIRPORT, DESTINATION_AIRPORT,
    CAST(sum(CAST(delay_probability AS DECIMAL(30,6))) AS DOUBLE) / count(delay_probability) AS m
  FROM scored GROUP BY 1, 2) t""", ("scored",))
def q_d14b(spark, sf):
    return D.route_risk(V(spark, sf, "scored"), decimals=6).select("ORIGIN_AIRPORT", "DESTINATION_AIRPORT", "risk_level")


def _mean6(c):
    return f"CAST(sum(CAST({c} AS DECIMAL(30,6))) AS DOUBLE) / count({c})"


@query("D15_best_options", f"""
WITH {SC}, w AS (SELECT * FROM {window_sql('sc', AS_OF_FUTURE)} w0),
keys AS (SELECT DISTINCT ORIGIN_AIRPORT, DESTINATION_AIRPORT FROM w),
bd AS (SELECT ORIGIN_AIRPORT, DESTINATION_AIRPORT, arg_min(fd, (m, fd)) AS lowest_risk_day FROM (
  SELECT ORIGIN_AIRPORT, DESTINATION_AIRPORT, fd, {_mean6('delay_probability')} AS m FROM w WHERE fd IS NOT NULL
  GROUP BY 1, 2, 3) t GROUP BY 1, 2),
ba AS (SELECT ORIGIN_AIRPORT, DESTINATION_AIRPORT, arg_min(a, (m, a)) AS lowest_risk_airline FROM (
  SELECT ORIGIN_AIRPORT, DESTINATION_AIRPORT, upper(trim(AIRLINE)) AS a, {_mean6('delay_probability')} AS m FROM w
  WHERE AIRLINE IS NOT NULL GROUP BY 1, 2, 3) t GROUP BY 1, 2),
bp AS (SELECT ORIGIN_AIRPORT, DESTINATION_AIRPORT,
  arg_min({fmt_hhmm_sql('SCHEDULED_DEPARTURE')}, (delay_probability, SCHEDULED_DEPARTURE)) AS lower_risk_departure
  FROM w WHERE SCHEDULED_DEPARTURE IS NOT NULL AND delay_probability IS NOT NULL GROUP BY 1, 2)
SELECT k.ORIGIN_AIRPORT, k.DESTINATION_AIRPORT, strftime(bd.lowest_risk_day, '%Y-%m-%d') AS lowest_risk_day,
  ba.lowest_risk_airline, bp.lower_risk_departure
FROM keys k LEFT JOIN bd ON k.ORIGIN_AIRPORT IS NOT DISTINCT FROM bd.ORIGIN_AIRPORT
  AND k.DESTINATION_AIRPORT IS NOT DISTINCT FROM bd.DESTINATION_AIRPORT
LEFT JOIN ba ON k.ORIGIN_AIRPORT IS NOT DISTINCT FROM ba.ORIGIN_AIRPORT
  AND k.DESTINATION_AIRPORT IS NOT DISTINCT FROM ba.DESTINATION_AIRPORT
LEFT JOIN bp ON k.ORIGIN_AIRPORT IS NOT DISTINCT FROM bp.ORIGIN_AIRPORT
  AND k.DESTINATION_AIRPORT IS NOT DISTINCT FROM bp.DESTINATION_AIRPORT""", ("scored",))
def q_d15(spark, sf):
    w = B.upcoming_window(V(spark, sf, "scored"), AS_OF_FUTURE)
    out = D.best_options(w, decimals=6)
    return out.withColumn("lowest_risk_day", F.date_format("lowest_risk_day", "yyyy-MM-dd"))


GRID_SCORE = "((request_id * 31 + slot_departure * 7) % 1000) / 1000.0E0"


@query("D16_day_average_risk", f"""
SELECT request_id, CAST(sum(CAST(p AS DECIMAL(30,6))) AS DOUBLE) / count(p) AS day_average_probability, count(*) AS slots
FROM (SELECT request_id, {GRID_SCORE} AS p FROM (
  SELECT request_id, COALESCE(scheduled_departure, s * 100) AS slot_departure
  FROM requests, range(0, 24) r(s) WHERE scheduled_departure IS NULL OR s = 0) g) t GROUP BY 1""", ("requests",))
def q_d16(spark, sf):
    g = J.hour_grid(V(spark, sf, "requests"), "scheduled_departure")
    g = g.withColumn("delay_probability", F.expr(GRID_SCORE.replace("1000.0E0", "1000.0D")))
    return D.day_average_risk(g, ["request_id"], decimals=6)


@query("D17_destination_countries", """
SELECT ORIGIN_AIRPORT, string_agg(country, '|' ORDER BY country) AS countries, count(*) AS n_countries FROM (
  SELECT DISTINCT upper(trim(f.ORIGIN_AIRPORT)) AS ORIGIN_AIRPORT, i.country FROM flights f
  JOIN airports_idx i ON upper(trim(f.DESTINATION_AIRPORT)) = i.iata_code) t GROUP BY 1""", ("flights", "airports_idx"))
def q_d17(spark, sf):
    return D.destination_countries(V(spark, sf, "flights"), airports_idx(spark, sf))


@query("D18_partition_list", "SELECT DISTINCT year, month FROM slim WHERE year IS NOT NULL AND month IS NOT NULL", ("slim",))
def q_d18(spark, sf):
    return D.partition_list(slim(spark, sf))


@query("D19_partition_counts", "SELECT year, month, count(*) AS rows FROM slim GROUP BY 1, 2", ("slim",))
def q_d19(spark, sf):
    return D.partition_counts(slim(spark, sf))


@query("D20_impute_values", """
SELECT 'SCHEDULED_DEPARTURE' AS feature, 'numeric' AS kind, median(CAST(SCHEDULED_DEPARTURE AS DOUBLE)) AS num_value,
  NULL AS cat_value FROM enriched
UNION ALL SELECT 'DISTANCE', 'numeric', median(DISTANCE), NULL FROM enriched
UNION ALL SELECT 'AIRLINE', 'categorical', NULL, arg_min(v, (-n, v)) FROM (
  SELECT AIRLINE AS v, count(*) AS n FROM enriched WHERE AIRLINE IS NOT NULL GROUP BY 1) t
UNION ALL SELECT 'DESTINATION_AIRPORT', 'categorical', NULL, arg_min(v, (-n, v)) FROM (
  SELECT DESTINATION_AIRPORT AS v, count(*) AS n FROM enriched WHERE DESTINATION_AIRPORT IS NOT NULL GROUP BY 1) t""",
       ("enriched",))
def q_d20(spark, sf):
    return D.impute_values(enriched(spark, sf), ["SCHEDULED_DEPARTURE", "DISTANCE"], ["AIRLINE", "DESTINATION_AIRPORT"])


# ---------------------------------------------------------------------------------------------- E / F
@query("E2_top_factors", f"""
WITH g AS (SELECT global_rate FROM grate), t AS (
  SELECT {KEYS_SQL}, list_sort_items FROM (
    SELECT *, [
      {{'d': abs(ORIGIN_DELAY_RATE - g.global_rate), 'i': 0, 'f': 'origin_delay_rate', 'x': ORIGIN_DELAY_RATE - g.global_rate}},
      {{'d': abs(DEST_DELAY_RATE - g.global_rate), 'i': 1, 'f': 'dest_delay_rate', 'x': DEST_DELAY_RATE - g.global_rate}},
      {{'d': abs(CARRIER_DELAY_RATE - g.global_rate), 'i': 2, 'f': 'carrier_delay_rate', 'x': CARRIER_DELAY_RATE - g.global_rate}},
      {{'d': abs(ROUTE_DELAY_RATE - g.global_rate), 'i': 3, 'f': 'route_delay_rate', 'x': ROUTE_DELAY_RATE - g.global_rate}},
      {{'d': abs(CARRIER_DELAY_RATE_DOW - g.global_rate), 'i': 4, 'f': 'carrier_delay_rate_dow',
        'x': CARRIER_DELAY_RATE_DOW - g.global_rate}}] AS list_sort_items
    FROM processed, g WHERE NOT is_train) s)
SELECT {KEYS_SQL}, array_to_string(list_transform(list_slice(list_sort(list_transform(list_sort_items,
  lambda e: {{'nd': -e.d, 'i': e.i, 'f': e.f, 'x': e.x}})), 1, 3), lambda e: e.f), ',') AS features
FROM t""", ("processed",))
def q_e2(spark, sf):
    p = pre(spark, sf)
    g = p.global_rate.first()["global_rate"]
    out = R.top_factors(p.test, g)
    return out.select(*KEYS, F.array_join(F.transform("top_factors", lambda s: s["feature"]), ",").alias("features"))


@query("E4_keep_first", """
SELECT ROUTE, arg_min(l_orderkey, (SCHEDULED_DEPARTURE IS NULL, SCHEDULED_DEPARTURE, l_orderkey, l_linenumber, l_partkey,
  l_suppkey)) AS l_orderkey FROM enriched WHERE ROUTE IS NOT NULL GROUP BY 1""", ("enriched",))
def q_e4(spark, sf):
    e = enriched(spark, sf).where(F.col("ROUTE").isNotNull()).select("ROUTE", "SCHEDULED_DEPARTURE", *KEYS)
    first = R.keep_first(e, ["ROUTE"], [F.col("SCHEDULED_DEPARTURE"), F.col("l_orderkey"), F.col("l_linenumber"),
                                         F.col("l_partkey"), F.col("l_suppkey")])
    return first.select("ROUTE", "l_orderkey")


def _window_rows(spark, sf, as_of=AS_OF_FUTURE):
    return B.upcoming_window(V(spark, sf, "scored"), as_of)


@query("F2_upcoming_flights", f"""
WITH {SC}, w AS (SELECT * FROM {window_sql('sc', AS_OF_FUTURE)} w0)
SELECT strftime(fd, '%Y-%m-%d') AS flight_date, CAST(FLIGHT_NUMBER AS VARCHAR) AS flight_number,
  upper(trim(AIRLINE)) AS airline, upper(trim(ORIGIN_AIRPORT)) AS origin_airport,
  upper(NULLIF(trim(DESTINATION_AIRPORT), '')) AS destination_airport,
  {fmt_hhmm_sql('SCHEDULED_DEPARTURE')} AS scheduled_departure, DISTANCE AS distance_miles, used_future,
  CASE WHEN DESTINATION_AIRPORT IS NOT NULL THEN upper(trim(ORIGIN_AIRPORT)) || ' -> ' || upper(trim(DESTINATION_AIRPORT))
  END AS route, (SELECT count(*) FROM w) AS matched
FROM w ORDER BY fd, COALESCE(SCHEDULED_DEPARTURE, 9999), AIRLINE, FLIGHT_NUMBER, ORIGIN_AIRPORT,
  DESTINATION_AIRPORT NULLS LAST, DISTANCE LIMIT 50""", ("scored",))
def q_f2(spark, sf):
    return R.upcoming_flights(V(spark, sf, "scored"), AS_OF_FUTURE, 50)


@query("F3_airport_departures", f"""
WITH {SC}, o AS (SELECT * FROM sc WHERE upper(trim(ORIGIN_AIRPORT)) = 'N07'), w AS (SELECT * FROM {window_sql('o', AS_OF_FUTURE)} w0)
SELECT strftime(fd, '%Y-%m-%d') AS flight_date, strftime(fd, '%d/%m/%Y') AS flight_date_br,
  upper(trim(AIRLINE)) AS airline, CAST(FLIGHT_NUMBER AS VARCHAR) AS flight_number,
  upper(trim(AIRLINE)) || CAST(FLIGHT_NUMBER AS VARCHAR) AS flight_code, 'N07' AS origin_airport,
  upper(NULLIF(trim(DESTINATION_AIRPORT), '')) AS destination_airport,
  {fmt_hhmm_sql('SCHEDULED_DEPARTURE')} AS scheduled_departure, used_future, (SELECT count(*) FROM w) AS matched
FROM w ORDER BY fd, COALESCE(SCHEDULED_DEPARTURE, 9999), AIRLINE, FLIGHT_NUMBER,
  DESTINATION_AIRPORT NULLS LAST LIMIT 40""", ("scored",))
def q_f3(spark, sf):
    return R.airport_departures(V(spark, sf, "scored"), " n07", AS_OF_FUTURE, 40)


@query("F4_airports_of_country", """
SELECT * FROM airports_idx WHERE lower(trim(country)) = 'europe'
ORDER BY city NULLS LAST, airport_name NULLS LAST, iata_code NULLS LAST LIMIT 3""", ("airports_idx",))
def q_f4(spark, sf):
    return R.airports_of_country(airports_idx(spark, sf), "Europe", 3)


RANK_ORDER = "delay_probability NULLS LAST, fd NULLS LAST, COALESCE(SCHEDULED_DEPARTURE, 9999), k1 NULLS LAST, k2 NULLS LAST"


@query("F6_rank_schedule", f"""
WITH {SC}, w AS (SELECT *, upper(NULLIF(trim(AIRLINE), '')) AS k1, CAST(FLIGHT_NUMBER AS VARCHAR) AS k2,
    {fmt_hhmm_sql('SCHEDULED_DEPARTURE')} AS k3 FROM {window_sql('sc', AS_OF_FUTURE)} w0),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ORIGIN_AIRPORT, DESTINATION_AIRPORT, fd, k1, k2, k3
      ORDER BY {RANK_ORDER}) AS r1 FROM w) t WHERE r1 = 1)
SELECT * FROM (SELECT ORIGIN_AIRPORT, DESTINATION_AIRPORT, strftime(fd, '%Y-%m-%d') AS flight_date, k1 AS airline,
  k2 AS flight_number, k3 AS scheduled_departure, delay_probability,
  CAST(row_number() OVER (PARTITION BY ORIGIN_AIRPORT, DESTINATION_AIRPORT ORDER BY {RANK_ORDER}) AS INTEGER) AS rank
  FROM d) t
WHERE rank <= 3""", ("scored",))
def q_f6(spark, sf):
    ranked = R.rank_schedule(_window_rows(spark, sf), 3)
    return ranked.select("ORIGIN_AIRPORT", "DESTINATION_AIRPORT",
                         F.date_format("_flight_date", "yyyy-MM-dd").alias("flight_date"),
                         F.upper(X.blank_to_null("AIRLINE")).alias("airline"),
                         X.flight_number_text("FLIGHT_NUMBER").alias("flight_number"),
                         X.format_hhmm("SCHEDULED_DEPARTURE").alias("scheduled_departure"), "delay_probability", "rank")


@query("F9_destinations_board", f"""
WITH {SC}, o AS (SELECT * FROM sc WHERE upper(trim(ORIGIN_AIRPORT)) = 'N07'), w AS (SELECT * FROM {window_sql('o', AS_OF_FUTURE)} w0),
j AS (SELECT w.*, upper(trim(DESTINATION_AIRPORT)) AS dest, i.airport_name AS dname FROM w
  LEFT JOIN airports_idx i ON upper(trim(w.DESTINATION_AIRPORT)) = i.iata_code WHERE lower(i.country) = 'asia'),
f AS (SELECT dest, arg_min(dname, (fd IS NULL, fd, COALESCE(SCHEDULED_DEPARTURE, 9999), AIRLINE, FLIGHT_NUMBER,
  l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS airport_name,
  min((fd IS NULL, fd, COALESCE(SCHEDULED_DEPARTURE, 9999), AIRLINE, FLIGHT_NUMBER, l_orderkey, l_linenumber,
       l_partkey, l_suppkey)) AS k
  FROM j WHERE dest IS NOT NULL GROUP BY dest)
SELECT dest AS destination_airport, airport_name, strftime(k[2], '%Y-%m-%d') AS flight_date,
  {fmt_hhmm_sql('k[3]')} AS scheduled_departure, upper(k[4]) AS airline
FROM f ORDER BY k[2], k[3], dest LIMIT 30""", ("scored", "airports_idx"))
def q_f9(spark, sf):
    w = B.upcoming_window(V(spark, sf, "scored").where(X.code_text("ORIGIN_AIRPORT") == "N07"), AS_OF_FUTURE)
    w = w.select("_flight_date", "SCHEDULED_DEPARTURE", "AIRLINE", "FLIGHT_NUMBER", *KEYS, "DESTINATION_AIRPORT")
    return R.destinations_board(w, airports_idx(spark, sf), "Asia", 30)


# ---------------------------------------------------------------------------------------------- H
@query("H8_clamp_hhmm", """
SELECT request_id, CAST(LEAST(GREATEST(v // 100, 0), 23) * 100 + LEAST(GREATEST(v % 100, 0), 59) AS INTEGER) AS departure
FROM (
  SELECT request_id, LEAST(GREATEST(COALESCE(CAST(trunc(scheduled_departure) AS BIGINT), 1200), 0), 2359) AS v
  FROM requests) t""", ("requests",))
def q_h8(spark, sf):
    return V(spark, sf, "requests").select("request_id", X.clamp_hhmm("scheduled_departure").alias("departure"))


@query("H9_H10_H11_H12_formats", f"""
SELECT {KEYS_SQL}, {fmt_hhmm_sql('SCHEDULED_DEPARTURE')} AS departure_text,
  COALESCE(CAST(SCHEDULED_DEPARTURE AS BIGINT), 9999) AS departure_key, CAST(FLIGHT_NUMBER AS VARCHAR) AS flight_number,
  AIRLINE || CAST(FLIGHT_NUMBER AS VARCHAR) AS flight_code,
  strftime(make_date(YEAR, MONTH, DAY), '%d/%m/%Y') AS date_dmy FROM flights""", ("flights",))
def q_h9(spark, sf):
    f = V(spark, sf, "flights")
    fn = X.flight_number_text("FLIGHT_NUMBER")
    return f.select(*KEYS, X.format_hhmm("SCHEDULED_DEPARTURE").alias("departure_text"),
                    X.departure_sort_key("SCHEDULED_DEPARTURE").alias("departure_key"), fn.alias("flight_number"),
                    X.flight_code("AIRLINE", fn).alias("flight_code"),
                    X.date_dmy(F.format_string("%04d-%02d-%02d", "YEAR", "MONTH", "DAY")).alias("date_dmy"))


@query("H13_infer_date", f"""
WITH r AS (SELECT request_id, try_cast(flight_date AS DATE) AS fd, month AS m, day_of_week AS w,
  CAST(NULL AS INTEGER) AS d, DATE '{AS_OF_FUTURE}' AS today FROM requests),
e AS (SELECT *, COALESCE(m, month(today)) AS me,
  year(today) + CASE WHEN COALESCE(m, month(today)) < month(today) THEN 1 ELSE 0 END AS ye FROM r)
SELECT request_id, strftime(CASE WHEN fd IS NOT NULL THEN fd
  WHEN m IS NULL AND w IS NULL AND d IS NULL THEN today
  WHEN m IS NULL AND w IS NOT NULL THEN today + CAST(((w - isodow(today)) % 7 + 7) % 7 AS INTEGER)
  WHEN w IS NULL THEN make_date(ye, me, 1)
  ELSE make_date(ye, me, 1) + CAST(((w - isodow(make_date(ye, me, 1))) % 7 + 7) % 7 AS INTEGER) END, '%Y-%m-%d')
  AS inferred_date FROM e""", ("requests",))
def q_h13(spark, sf):
    r = V(spark, sf, "requests")
    d = X.infer_date(AS_OF_FUTURE, flight_date="flight_date", month="month", dow="day_of_week")
    return r.select("request_id", F.date_format(d, "yyyy-MM-dd").alias("inferred_date"))


@query("H15_H16_risk_and_prediction", f"""
SELECT {KEYS_SQL}, CASE WHEN delay_probability >= 0.7 THEN 'HIGH' WHEN delay_probability >= 0.4 THEN 'MEDIUM'
  WHEN delay_probability IS NOT NULL THEN 'LOW' END AS risk_level,
  CAST(delay_probability >= 0.35 AS INTEGER) AS delay_prediction FROM scored""", ("scored",))
def q_h15(spark, sf):
    s = V(spark, sf, "scored")
    return s.select(*KEYS, X.risk_level("delay_probability").alias("risk_level"),
                    X.delay_prediction("delay_probability", 0.35).alias("delay_prediction"))


# ---------------------------------------------------------------------------------------------- I9
_WEEK_SQL = MATCH_SQL + " WHERE make_date(p.YEAR, p.MONTH, p.DAY) >= DATE '1998-06-01' AND make_date(p.YEAR, p.MONTH, p.DAY) < DATE '1998-06-08'"


@query("I9_weekly_validate", D11_SQL.replace(MATCH_SQL, _WEEK_SQL).replace("AS total_matched,", "AS total_matched, '1998-06-01' AS week_start,"),
       ("predictions", "actuals"))
def q_i9(spark, sf):
    from skydelay.plans.weekly import weekly_validate
    return weekly_validate(V(spark, sf, "predictions"), V(spark, sf, "actuals"), "1998-06-01", 7)
