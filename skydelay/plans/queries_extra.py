"""Registered queries for inventory items otherwise exercised only inside larger queries: A9, E9, E10, E12, G1, J6."""

from __future__ import annotations

from pyspark.sql import functions as F

from skydelay.functions import exprs as X
from skydelay.operators import geo_text as G
from skydelay.operators import ranking as R
from skydelay.plans.queries import KEYS, KEYS_SQL, V, pre, query
from skydelay.plans.queries_live import scratch
from skydelay.plans.queries_schedule import fmt_hhmm_sql
from skydelay.plans.queries_text import FRAGMENTS_SQL, PARTIAL_SQL, _frags_idx
from skydelay.sources import io as IO


@query("A9_write_tabular", f"SELECT {KEYS_SQL}, DISTANCE FROM flights UNION ALL SELECT {KEYS_SQL}, DISTANCE FROM flights",
       ("flights",))
def q_a9(spark, sf):
    f = V(spark, sf, "flights").select(*KEYS, "DISTANCE")
    base = scratch(spark, "tabular")
    p = IO.write_tabular(f, IO.lake_name(f"{base}/flights.csv"))          # lake target: normalized to parquet
    c = IO.write_tabular(f, f"{base}/flights_copy.csv")                    # explicit CSV
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, DISTANCE double"
    return IO.read_tabular(spark, p).unionByName(IO.read_tabular(spark, c, schema))


@query("E10_best_partial", "WITH " + FRAGMENTS_SQL + ",\n" + PARTIAL_SQL + """
SELECT fkey, iata_code, 4 AS level FROM best4 UNION ALL SELECT fkey, iata_code, 5 FROM best5""",
       ("questions", "airports_idx"))
def q_e10(spark, sf):
    frags, idx = _frags_idx(spark, sf)
    out = None
    for level, rkey, rtok in ((4, "name_norm", "name_tokens"), (5, "city_norm", "city_tokens")):
        b = G._best_partial(G._substring_candidates(frags, idx, rkey, rtok), idx, rkey, rtok) \
            .select("fkey", "iata_code", F.lit(level).alias("level"))
        out = b if out is None else out.unionByName(b)
    return out


@query("E9_primary_airport", "WITH " + FRAGMENTS_SQL + ",\n" + PARTIAL_SQL + """
SELECT fkey, p_code, p_country, 4 AS level FROM prim4 UNION ALL SELECT fkey, p_code, p_country, 5 FROM prim5""",
       ("questions", "airports_idx"))
def q_e9(spark, sf):
    frags, idx = _frags_idx(spark, sf)
    restr = G.country_restriction(frags, idx)
    out = None
    for level, rkey, rtok in ((4, "name_norm", "name_tokens"), (5, "city_norm", "city_tokens")):
        best = G._best_partial(G._substring_candidates(frags, idx, rkey, rtok), idx, rkey, rtok).join(restr, "fkey")
        kept = best.where(G.location_key("country") == G.location_key("filter_country"))
        p = G.primary_airport(kept).withColumn("level", F.lit(level))
        out = p if out is None else out.unionByName(p)
    return out


@query("E12_top_attributions", f"""
WITH t AS (SELECT * FROM processed WHERE NOT is_train), a AS (
  SELECT {KEYS_SQL}, [{{'abs': abs(ORIGIN_DELAY_RATE - DEST_DELAY_RATE), 'i': 0, 'feature': 'ORIGIN_DELAY_RATE',
      'attribution': ORIGIN_DELAY_RATE - DEST_DELAY_RATE}},
    {{'abs': abs(CARRIER_DELAY_RATE - ROUTE_DELAY_RATE), 'i': 1, 'feature': 'CARRIER_DELAY_RATE',
      'attribution': CARRIER_DELAY_RATE - ROUTE_DELAY_RATE}},
    {{'abs': abs(CARRIER_DELAY_RATE_DOW - CARRIER_DELAY_RATE), 'i': 2, 'feature': 'CARRIER_DELAY_RATE_DOW',
      'attribution': CARRIER_DELAY_RATE_DOW - CARRIER_DELAY_RATE}}] AS items FROM t)
SELECT {KEYS_SQL}, CAST(r AS INTEGER) AS rank, items[r].feature AS feature, items[r].attribution AS attribution FROM (
  SELECT {KEYS_SQL}, list_sort(list_transform(items, lambda e: {{'nabs': -e.abs, 'i': e.i, 'feature': e.feature,
    'attribution': e.attribution}})) AS items, unnest(range(1, 3)) AS r FROM a) s""", ("processed",))
def q_e12(spark, sf):
    t = pre(spark, sf).test.select(
        *KEYS, "ORIGIN_DELAY_RATE", "CARRIER_DELAY_RATE", "CARRIER_DELAY_RATE_DOW",
        (F.col("ORIGIN_DELAY_RATE") - F.col("DEST_DELAY_RATE")).alias("attr_ORIGIN_DELAY_RATE"),
        (F.col("CARRIER_DELAY_RATE") - F.col("ROUTE_DELAY_RATE")).alias("attr_CARRIER_DELAY_RATE"),
        (F.col("CARRIER_DELAY_RATE_DOW") - F.col("CARRIER_DELAY_RATE")).alias("attr_CARRIER_DELAY_RATE_DOW"))
    out = R.top_attributions(t, KEYS, ["ORIGIN_DELAY_RATE", "CARRIER_DELAY_RATE", "CARRIER_DELAY_RATE_DOW"], k=2)
    return out.select(*KEYS, "rank", "feature", "attribution")


@query("G1_union_attempts", f"""
WITH s AS (SELECT *, make_date(YEAR, MONTH, DAY) AS fd FROM scored WHERE upper(trim(ORIGIN_AIRPORT)) = 'N05'),
u AS (SELECT *, 0 AS attempt FROM s WHERE MONTH = 6 UNION ALL SELECT *, 1 AS attempt FROM s)
SELECT {KEYS_SQL}, attempt FROM (SELECT *, row_number() OVER (PARTITION BY strftime(fd, '%Y-%m-%d'), upper(trim(AIRLINE)),
    CAST(FLIGHT_NUMBER AS VARCHAR), {fmt_hhmm_sql('SCHEDULED_DEPARTURE')}
    ORDER BY attempt, delay_probability, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM u) x WHERE rn = 1""",
       ("scored",))
def q_g1(spark, sf):
    s = V(spark, sf, "scored").where(X.code_text("ORIGIN_AIRPORT") == "N05") \
        .withColumn("_flight_date", X.flight_date(V(spark, sf, "scored").columns))
    parts = [s.where(F.col("MONTH") == 6).withColumn("attempt", F.lit(0)), s.withColumn("attempt", F.lit(1))]
    dedupe = [F.date_format("_flight_date", "yyyy-MM-dd"), F.upper(X.blank_to_null("AIRLINE")),
              X.flight_number_text("FLIGHT_NUMBER"), X.format_hhmm("SCHEDULED_DEPARTURE")]
    u = R.union_attempts(parts, dedupe, [F.col("delay_probability"), *[F.col(k) for k in KEYS]])
    return u.select(*KEYS, "attempt")


@query("J6_score_stream")
def q_j6(spark, sf):
    from skydelay.plans.queries_ml import fitted
    from skydelay.streaming import live as S
    model, fs, p = fitted(spark, sf, "logreg")
    src = scratch(spark, "sched-src")
    tasks = spark.sparkContext.defaultParallelism  # a micro-batch is a file for each of them: four micro-batches in all
    p.test.repartition(4 * tasks).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = S.stream_files(spark, src, schema, max_files=tasks)
    out = scratch(spark, "scored-stream")
    S.run_available_now(S.score_stream(stream, model).select(*KEYS, "delay_probability", "delay_prediction"), out,
                        scratch(spark, "j6-ckpt"))
    return spark.read.parquet(out)



@query("H1_H7_flight_columns", f"""
SELECT {KEYS_SQL}, LEAST(GREATEST(CAST(floor(COALESCE(SCHEDULED_DEPARTURE, 0) / 100) AS INTEGER), 0), 23) AS dep_hour,
  CASE WHEN LEAST(GREATEST(CAST(floor(COALESCE(SCHEDULED_DEPARTURE, 0) / 100) AS INTEGER), 0), 23) BETWEEN 5 AND 11 THEN 'morning'
       WHEN LEAST(GREATEST(CAST(floor(COALESCE(SCHEDULED_DEPARTURE, 0) / 100) AS INTEGER), 0), 23) BETWEEN 12 AND 16 THEN 'afternoon'
       WHEN LEAST(GREATEST(CAST(floor(COALESCE(SCHEDULED_DEPARTURE, 0) / 100) AS INTEGER), 0), 23) BETWEEN 17 AND 21 THEN 'evening'
       ELSE 'night' END AS time_of_day,
  CASE WHEN MONTH IN (12, 1, 2) THEN 'winter' WHEN MONTH IN (3, 4, 5) THEN 'spring' WHEN MONTH IN (6, 7, 8) THEN 'summer'
       ELSE 'fall' END AS season,
  strftime(make_date(YEAR, MONTH, DAY), '%Y-%m-%d') AS flight_date,
  ORIGIN_AIRPORT || '-' || DESTINATION_AIRPORT AS route, AIRLINE || '_' || CAST(DAY_OF_WEEK AS VARCHAR) AS airline_dow,
  CAST(CASE WHEN ARRIVAL_DELAY > 15 THEN 1 ELSE 0 END AS INTEGER) AS is_delayed
FROM flights""", ("flights",))
def q_h1_h7(spark, sf):
    f = V(spark, sf, "flights")
    h = X.dep_hour("SCHEDULED_DEPARTURE")
    return f.select(*KEYS, h.alias("dep_hour"), X.time_of_day(h).alias("time_of_day"), X.season("MONTH").alias("season"),
                    F.date_format(X.flight_date(f.columns), "yyyy-MM-dd").alias("flight_date"),
                    X.route_key("ORIGIN_AIRPORT", "DESTINATION_AIRPORT").alias("route"),
                    X.airline_dow("AIRLINE", "DAY_OF_WEEK").alias("airline_dow"),
                    X.is_delayed("ARRIVAL_DELAY").alias("is_delayed"))
