"""Registered queries: requests as a table (H14, H17, I12-I14), advisor factors (E3), suggestions (F5 / G1) and
airports per country (D10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skydelay.operators import ranking as R
from skydelay.operators import stats as D
from skydelay.plans import requests as Q
from skydelay.plans.fixtures import AS_OF_FUTURE
from skydelay.plans.queries import KEYS_SQL, V, enriched, pre, query
from skydelay.plans.queries_schedule import _mean6, airports_idx, fmt_hhmm_sql
from skydelay.session import cut_lineage


def surrogate_scorer(df):
    """Deterministic stand-in for a fitted model (the ML path itself is checked by the I2-I7 queries)."""
    p = F.pmod(F.coalesce(F.col("SCHEDULED_DEPARTURE"), F.lit(0)) * 7 + F.coalesce(F.col("DISTANCE"), F.lit(0)).cast("long") * 3
               + F.col("MONTH") * 11 + F.col("DAY_OF_WEEK") * 13, F.lit(1000)) / 1000.0
    return df.withColumn("delay_probability", p.cast("double"))


@query("D10_airports_per_country", """
SELECT country, count(*) AS airports, count(*) OVER () AS n_countries FROM airports_idx WHERE country IS NOT NULL
GROUP BY country""", ("airports_idx",))
def q_d10(spark, sf):
    return D.airports_per_country(airports_idx(spark, sf))


@query("H14_resolve_distance", """
WITH rd AS (SELECT ROUTE, avg(DISTANCE) AS m FROM enriched WHERE ROUTE IS NOT NULL GROUP BY ROUTE),
g AS (SELECT avg(DISTANCE) AS m FROM enriched)
SELECT request_id, COALESCE(r.distance, rd.m, g.m) AS resolved_distance,
  CASE WHEN r.distance IS NOT NULL THEN 'request' WHEN rd.m IS NOT NULL THEN 'route_average' ELSE 'global_average' END
    AS distance_source
FROM requests r LEFT JOIN rd ON rd.ROUTE = r.origin_airport || '-' || r.destination_airport, g""", ("enriched", "requests"))
def q_h14(spark, sf):
    rd = D.route_distance(enriched(spark, sf))
    return Q.resolve_distance(V(spark, sf, "requests"), rd).select("request_id", "resolved_distance", "distance_source")


@query("H17_request_mode", """
SELECT request_id, CASE WHEN NULLIF(trim(origin_airport), '') IS NULL OR NULLIF(trim(destination_airport), '') IS NULL
    THEN 'discovery'
  WHEN NULLIF(trim(airline), '') IS NOT NULL AND scheduled_departure IS NOT NULL
    AND (flight_date IS NOT NULL OR month IS NOT NULL OR day_of_week IS NOT NULL) THEN 'route'
  ELSE 'weekly_route' END AS mode,
  array_to_string(list_filter([CASE WHEN NULLIF(trim(origin_airport), '') IS NULL THEN 'origin airport' END,
    CASE WHEN NULLIF(trim(destination_airport), '') IS NULL THEN 'destination airport' END], lambda x: x IS NOT NULL), ';')
    AS missing
FROM requests""", ("requests",))
def q_h17(spark, sf):
    r = V(spark, sf, "requests")
    return r.select("request_id", Q.request_mode(date_parts=("flight_date", "month", "day_of_week")).alias("mode"),
                    F.array_join(Q.missing_fields(), ";").alias("missing"))


E2_ITEMS = """[
      {'d': abs(ORIGIN_DELAY_RATE - g.global_rate), 'i': 0, 'f': 'origin_delay_rate'},
      {'d': abs(DEST_DELAY_RATE - g.global_rate), 'i': 1, 'f': 'dest_delay_rate'},
      {'d': abs(CARRIER_DELAY_RATE - g.global_rate), 'i': 2, 'f': 'carrier_delay_rate'},
      {'d': abs(ROUTE_DELAY_RATE - g.global_rate), 'i': 3, 'f': 'route_delay_rate'},
      {'d': abs(CARRIER_DELAY_RATE_DOW - g.global_rate), 'i': 4, 'f': 'carrier_delay_rate_dow'}]"""


@query("E3_advisor_factors", f"""
WITH g AS (SELECT global_rate FROM grate), t AS (
  SELECT {KEYS_SQL}, list_filter([CASE WHEN SCHEDULED_DEPARTURE IS NULL THEN 'departure_window_average' END, 'distance'],
      lambda x: x IS NOT NULL) AS ctx,
    list_transform(list_slice(list_sort(list_transform({E2_ITEMS}, lambda e: {{'nd': -e.d, 'i': e.i, 'f': e.f}})), 1, 3),
      lambda e: e.f) AS model
  FROM processed, g WHERE NOT is_train)
SELECT {KEYS_SQL}, array_to_string(list_slice(list_concat(ctx, list_filter(model, lambda f: NOT list_contains(ctx, f))), 1, 3),
  ',') AS factors FROM t""", ("processed",))
def q_e3(spark, sf):
    p = pre(spark, sf)
    g = p.global_rate.first()["global_rate"]
    t = R.top_factors(p.test, g)
    ctx = F.array_compact(F.array(
        F.when(F.col("SCHEDULED_DEPARTURE").isNull(), F.struct(F.lit("departure_window_average").alias("feature"),
                                                               F.lit("").alias("impact"))),
        F.struct(F.lit("distance").alias("feature"), F.lit("").alias("impact"))))
    out = R.advisor_factors(t.withColumn("context_factors", ctx))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      F.array_join(F.transform("advisor_factors", lambda s: s["feature"]), ",").alias("factors"))


REQ = {"origin_airport": "n05", "destination_airport": "N12", "month": 6, "airline": "Brand#13",
       "scheduled_departure": 1015}


@query("F5_suggest_flights", f"""
WITH s AS (SELECT *, make_date(YEAR, MONTH, DAY) AS fd, upper(trim(AIRLINE)) = 'BRAND#13' AS same_airline,
    COALESCE(CAST(SCHEDULED_DEPARTURE AS BIGINT), 9999) AS dk FROM scored
  WHERE upper(trim(ORIGIN_AIRPORT)) = 'N05' AND upper(trim(DESTINATION_AIRPORT)) = 'N12'
    AND NOT (upper(trim(AIRLINE)) IS NOT DISTINCT FROM 'BRAND#13' AND CAST(SCHEDULED_DEPARTURE AS DOUBLE) IS NOT DISTINCT FROM 1015)),
u AS (SELECT *, 0 AS attempt FROM s WHERE MONTH = 6 UNION ALL SELECT *, 1 AS attempt FROM s),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strftime(fd, '%Y-%m-%d'), upper(trim(AIRLINE)),
    CAST(FLIGHT_NUMBER AS VARCHAR), {fmt_hhmm_sql('SCHEDULED_DEPARTURE')}
    ORDER BY attempt, delay_probability, fd, same_airline DESC, dk) AS rn FROM u) x WHERE rn = 1)
SELECT strftime(fd, '%Y-%m-%d') AS flight_date, upper(trim(AIRLINE)) AS airline, CAST(FLIGHT_NUMBER AS VARCHAR) AS flight_number,
  {fmt_hhmm_sql('SCHEDULED_DEPARTURE')} AS scheduled_departure, delay_probability, attempt
FROM d ORDER BY attempt, delay_probability, fd, same_airline DESC, dk, AIRLINE, FLIGHT_NUMBER LIMIT 3""", ("scored",))
def q_f5(spark, sf):
    from skydelay.functions import exprs as X
    out = R.suggest_flights(V(spark, sf, "scored"), REQ, 3)
    return out.select(F.date_format("_flight_date", "yyyy-MM-dd").alias("flight_date"),
                      F.upper(F.trim("AIRLINE")).alias("airline"), X.flight_number_text("FLIGHT_NUMBER").alias("flight_number"),
                      X.format_hhmm("SCHEDULED_DEPARTURE").alias("scheduled_departure"), "delay_probability", "attempt")


def _snapshot(spark, sf):
    p = pre(spark, sf)
    g = p.global_rate.first()["global_rate"]
    rd = D.route_distance(enriched(spark, sf))
    return Q.delay_snapshot(V(spark, sf, "requests"), p.rates, g, rd, surrogate_scorer, AS_OF_FUTURE)


def _weekly(spark, sf):
    sched = V(spark, sf, "scored")
    return Q.weekly_route_estimate(V(spark, sf, "requests"), sched, AS_OF_FUTURE)


@query("I12_delay_snapshot")
def q_i12(spark, sf):
    s = _snapshot(spark, sf)
    return s.select("request_id", "delay_probability", "slots", "risk_level", "delay_prediction", "departure_source",
                    "distance_source", F.array_join(F.transform("advisor_factors", lambda x: x["feature"]), ",").alias("factors"))


TODAY_SQL = f"CAST('{AS_OF_FUTURE}' AS DATE)"


WEEK_SQL = f"""
r AS (SELECT request_id, upper(trim(origin_airport)) AS o, upper(trim(destination_airport)) AS d, upper(NULLIF(trim(airline), '')) AS a,
    scheduled_departure AS dep, year AS y, month AS m, day AS dd, day_of_week AS w, TRY_CAST(flight_date AS DATE) AS fd, flight_date IS NOT NULL AS dated
  FROM requests WHERE NULLIF(trim(origin_airport), '') IS NOT NULL AND NULLIF(trim(destination_airport), '') IS NOT NULL),
s AS (SELECT make_date(YEAR, MONTH, DAY) AS f, YEAR AS sy, MONTH AS sm, DAY AS sd, DAY_OF_WEEK AS sw, upper(trim(AIRLINE)) AS sa,
    CAST(SCHEDULED_DEPARTURE AS DOUBLE) AS sdep, {fmt_hhmm_sql('SCHEDULED_DEPARTURE')} AS hhmm, SCHEDULED_DEPARTURE AS dk, CAST(FLIGHT_NUMBER AS VARCHAR) AS num,
    upper(trim(ORIGIN_AIRPORT)) AS so, upper(trim(DESTINATION_AIRPORT)) AS sdst, delay_probability AS p FROM scored),
j AS (SELECT r.*, s.* EXCLUDE (so, sdst), bool_or(s.f >= {TODAY_SQL}) OVER (PARTITION BY request_id) AS future FROM r JOIN s ON so = o AND sdst = d
  WHERE (a IS NULL OR sa = a) AND (dep IS NULL OR sdep = dep) AND (y IS NULL OR sy = y) AND (m IS NULL OR sm = m) AND (dd IS NULL OR sd = dd)
    AND (w IS NULL OR sw = w) AND (NOT dated OR f = fd)),
k AS (SELECT *, bool_or(f <= {TODAY_SQL} + 6) OVER (PARTITION BY request_id) AS capped FROM j WHERE NOT future OR f >= {TODAY_SQL}),
k2 AS (SELECT *, y IS NOT NULL OR m IS NOT NULL OR dd IS NOT NULL OR w IS NOT NULL OR dated AS named FROM k
  WHERE y IS NOT NULL OR m IS NOT NULL OR dd IS NOT NULL OR w IS NOT NULL OR dated OR NOT capped OR f <= {TODAY_SQL} + 6),
total AS (SELECT request_id, {_mean6('p')} AS mean_probability, count(*) AS flights, any_value(named) AS named, any_value(a) IS NULL AS any_airline,
  any_value(dep) IS NULL AS any_dep, arg_min(hhmm, (p, dk)) FILTER (WHERE dk IS NOT NULL) AS lower_risk_departure FROM k2 GROUP BY 1),
bday AS (SELECT request_id, arg_min(f, (m, f)) AS lowest_risk_day FROM (SELECT request_id, f, {_mean6('p')} AS m FROM k2 GROUP BY 1, 2) x GROUP BY 1),
bair AS (SELECT request_id, arg_min(sa, (m, sa)) AS lowest_risk_airline FROM (SELECT request_id, sa, {_mean6('p')} AS m FROM k2 WHERE sa IS NOT NULL
  GROUP BY 1, 2) x GROUP BY 1)"""


@query("I13_weekly_route_estimate", f"WITH {WEEK_SQL} SELECT request_id, mean_probability, flights FROM total", ("requests", "scored"))
def q_i13(spark, sf):
    return _weekly(spark, sf)[0].select("request_id", "mean_probability", "flights")


@query("I13_weekly_route_best", f"""WITH {WEEK_SQL}
SELECT request_id, mean_probability, flights, CASE WHEN mean_probability >= 0.7 THEN 'HIGH' WHEN mean_probability >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  strftime(lowest_risk_day, '%Y-%m-%d') AS lowest_risk_day, lowest_risk_airline, lower_risk_departure
FROM total JOIN bday USING (request_id) JOIN bair USING (request_id)""", ("requests", "scored"))
def q_i13c(spark, sf):
    return _weekly(spark, sf)[0].drop("weekly_factors").withColumn("lowest_risk_day", F.date_format("lowest_risk_day", "yyyy-MM-dd"))


@query("E3_weekly_factors", f"""WITH {WEEK_SQL}
SELECT request_id, array_to_string(list_slice(list_filter(['schedule_window=' || flights || ' flights in 7 days',
  CASE WHEN NOT named THEN 'lowest_risk_day=' || strftime(lowest_risk_day, '%d/%m/%Y') END,
  CASE WHEN any_airline THEN 'lowest_risk_airline=' || lowest_risk_airline END,
  CASE WHEN any_dep THEN 'lower_risk_departure=' || lower_risk_departure END], lambda x: x IS NOT NULL), 1, 3), ';') AS factors
FROM total JOIN bday USING (request_id) JOIN bair USING (request_id)""", ("requests", "scored"))
def q_e3w(spark, sf):
    """The schedule's factors of each request (E3)."""
    text = F.transform("weekly_factors", lambda f: F.concat(f["feature"], F.lit("="), f["impact"]))
    return _weekly(spark, sf)[0].select("request_id", F.array_join(text, ";").alias("factors"))


@query("I13_weekly_route_suggestions", f"""WITH {WEEK_SQL},
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, f, sa, num, hhmm ORDER BY p, dk) AS r1 FROM k2) x WHERE r1 = 1)
SELECT * FROM (SELECT request_id, strftime(f, '%Y-%m-%d') AS flight_date, sa AS AIRLINE, num AS FLIGHT_NUMBER, p AS delay_probability,
  CAST(row_number() OVER (PARTITION BY request_id ORDER BY p, f, COALESCE(dk, 9999), sa, num) AS INTEGER) AS rank FROM u) x WHERE rank <= 3""",
       ("requests", "scored"))
def q_i13b(spark, sf):
    _, sugg = _weekly(spark, sf)
    return sugg.select("request_id", F.date_format("_flight_date", "yyyy-MM-dd").alias("flight_date"), "AIRLINE",
                       "FLIGHT_NUMBER", "delay_probability", "rank")


@query("F5_suggest_for_requests", f"""
WITH r AS (SELECT request_id, upper(trim(origin_airport)) AS o, upper(trim(destination_airport)) AS d, upper(NULLIF(trim(airline), '')) AS a,
    CAST(scheduled_departure AS DOUBLE) AS dep, year AS y, month AS m, day AS dd, day_of_week AS w, TRY_CAST(flight_date AS DATE) AS f0, flight_date IS NOT NULL AS dated
  FROM requests WHERE NULLIF(trim(origin_airport), '') IS NOT NULL AND NULLIF(trim(destination_airport), '') IS NOT NULL),
s AS (SELECT make_date(YEAR, MONTH, DAY) AS fd, YEAR AS sy, MONTH AS sm, DAY AS sd, DAY_OF_WEEK AS sw, upper(trim(AIRLINE)) AS sa, SCHEDULED_DEPARTURE AS sdep,
    COALESCE(CAST(SCHEDULED_DEPARTURE AS BIGINT), 9999) AS dk, {fmt_hhmm_sql('SCHEDULED_DEPARTURE')} AS hhmm, CAST(FLIGHT_NUMBER AS VARCHAR) AS num,
    upper(trim(ORIGIN_AIRPORT)) AS so, upper(trim(DESTINATION_AIRPORT)) AS sdst, delay_probability AS p FROM scored),
j AS (SELECT r.*, s.*, COALESCE(sa = a, false) AS same, CASE WHEN (y IS NULL OR sy = y) AND (m IS NULL OR sm = m) AND (dd IS NULL OR sd = dd)
    AND (w IS NULL OR sw = w) AND (NOT dated OR fd = f0) THEN 0 ELSE 1 END AS attempt FROM r JOIN s ON so = o AND sdst = d
  WHERE NOT COALESCE(sa = a AND sdep = dep, false)),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, fd, sa, num, hhmm ORDER BY attempt, p, dk) AS r1 FROM j) x WHERE r1 = 1)
SELECT * FROM (SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY attempt, p, fd, same DESC, dk, sa, num) AS INTEGER) AS rank, attempt,
  strftime(fd, '%Y-%m-%d') AS flight_date, sa AS airline, num AS flight_number, hhmm AS scheduled_departure, p AS delay_probability FROM u) x
WHERE rank <= 3""", ("requests", "scored"))
def q_f5r(spark, sf):
    """Suggestions for every request of the table (F5)."""
    out = Q.suggest_for_requests(V(spark, sf, "requests"), V(spark, sf, "scored"))
    return out.select("request_id", "rank", "attempt", F.date_format("_flight_date", "yyyy-MM-dd").alias("flight_date"),
                      F.col("AIRLINE").alias("airline"), F.col("FLIGHT_NUMBER").alias("flight_number"),
                      F.col("SCHEDULED_DEPARTURE").alias("scheduled_departure"), "delay_probability")


SESSION_SQL = "request_id % 97 AS session_id, CAST(request_id % 9 AS BIGINT) AS turn"


def _in_sessions(spark, sf):
    """The requests as asked in sessions of the history."""
    return V(spark, sf, "requests").selectExpr("*", *SESSION_SQL.split(", "))


@query("I14_enrich_requests", f"""
WITH h AS (SELECT session_id, turn, NULLIF(trim(origin_airport), '') IS NOT NULL OR NULLIF(trim(origin_country), '') IS NOT NULL AS has_o,
    NULLIF(trim(destination_airport), '') IS NOT NULL OR NULLIF(trim(destination_country), '') IS NOT NULL AS has_d,
    origin_airport AS o, destination_airport AS d FROM history),
r AS (SELECT request_id, NULLIF(trim(origin_airport), '') AS o, NULLIF(trim(destination_airport), '') AS d, {SESSION_SQL} FROM requests),
c AS (SELECT r.request_id, max(h.turn) FILTER (WHERE has_o) AS ot, arg_max(h.o, h.turn) FILTER (WHERE has_o) AS ho,
    max(h.turn) FILTER (WHERE has_d) AS dt, arg_max(struct_pack(v := h.d), h.turn) FILTER (WHERE has_d) AS hd FROM r JOIN h ON h.session_id = r.session_id AND h.turn <= r.turn GROUP BY 1)
SELECT request_id, COALESCE(r.o, ho) AS origin_airport, COALESCE(r.d, hd.v) AS destination_airport,
  CASE WHEN r.o IS NOT NULL THEN 'request' WHEN ot IS NOT NULL THEN 'history' END AS origin_source,
  CASE WHEN r.d IS NOT NULL THEN 'request' WHEN dt IS NOT NULL THEN 'history' END AS destination_source
FROM r LEFT JOIN c USING (request_id)""", ("requests", "history"))
def q_i14e(spark, sf):
    """Requests whose empty sides their sessions fill (questions are resolved in I14_answer_requests)."""
    out = Q.enrich_requests(_in_sessions(spark, sf), V(spark, sf, "history"))
    return out.select("request_id", "origin_airport", "destination_airport", "origin_source", "destination_source")


@query("I14_answer_requests")
def q_i14(spark, sf):
    """Whole answers: requests enriched from their question (H24), else from their session, then scored and answered."""
    from skydelay.operators.geo_text import extract_route_text
    questions = V(spark, sf, "questions")
    said = extract_route_text(questions, "request_id", "question", airports_idx(spark, sf))
    asked = _in_sessions(spark, sf).join(questions, "request_id", "left")
    req = cut_lineage(Q.enrich_requests(asked, V(spark, sf, "history"), said))
    p = pre(spark, sf)
    g = p.global_rate.first()["global_rate"]
    schedule = V(spark, sf, "scored")
    snapshot = Q.delay_snapshot(req, p.rates, g, D.route_distance(enriched(spark, sf)), surrogate_scorer, AS_OF_FUTURE)
    summary, week = Q.weekly_route_estimate(req, schedule, AS_OF_FUTURE)
    out = Q.answer_requests(req, snapshot, summary, suggestions=Q.suggest_for_requests(req, schedule), weekly_suggestions=week)
    return out.select("request_id", "mode", "response.source", "response.delay_probability", "response.delay_prediction", "response.risk_level",
                      F.to_json("response.factors").alias("factors"), F.to_json("response.suggestions").alias("suggestions"),
                      F.array_join("response.missing_fields", ";").alias("missing_fields"), "response.topic")
