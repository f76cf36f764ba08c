"""Registered queries: live positions (A7, B17-B20, C8-C10, F7, H18-H20), the batch forms of the stream jobs (J1-J4),
the stream jobs themselves run with ``availableNow`` (J1, J3, J5), and the SQL functions (K1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skydelay.functions.register import register_functions
from skydelay.operators import joins as J
from skydelay.operators import live as L
from skydelay.operators import ranking as R
from skydelay.operators import rows as B
from skydelay.plans.queries import KEYS, KEYS_SQL, V, query
from skydelay.plans.queries_schedule import airports_idx, fmt_hhmm_sql
from skydelay.session import checkpoint_dir
from skydelay.streaming import live as S


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never a machine-local temp folder on a cluster)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex[:12]}"


STATE_TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER", "string": "VARCHAR"}


def _state_sql() -> str:
    cols = []
    for i, (name, typ) in enumerate(L.STATE_FIELDS):
        v = f"json_extract_string(raw, '$[{i}]')"
        cols.append(f"{v} AS {name}" if typ == "string" else f"TRY_CAST({v} AS {STATE_TYPES[typ]}) AS {name}")
    return "SELECT event_id, " + ", ".join(cols) + " FROM state_json WHERE json_valid(raw) AND json_type(raw) = 'ARRAY'"


@query("A7_parse_state_vectors", _state_sql(), ("state_json",))
def q_a7(spark, sf):
    return L.parse_state_vectors(V(spark, sf, "state_json"), "raw", keep=("event_id",))


LIVE_COLS = "event_id, icao24, latitude, longitude, on_ground"


@query("B17_valid_positions", f"SELECT {LIVE_COLS} FROM live_states WHERE latitude IS NOT NULL AND longitude IS NOT NULL "
                              "AND NOT COALESCE(on_ground, false)", ("live_states",))
def q_b17(spark, sf):
    return B.valid_positions(V(spark, sf, "live_states")).select(*LIVE_COLS.split(", "))


@query("B17_valid_positions_ground", f"SELECT {LIVE_COLS} FROM live_states WHERE latitude IS NOT NULL "
                                     "AND longitude IS NOT NULL", ("live_states",))
def q_b17g(spark, sf):
    return B.valid_positions(V(spark, sf, "live_states"), include_ground=True).select(*LIVE_COLS.split(", "))


@query("B18_in_region", f"SELECT {LIVE_COLS} FROM live_states WHERE latitude BETWEEN 35.0 AND 72.0 "
                        "AND longitude BETWEEN -25.0 AND 45.0", ("live_states",))
def q_b18(spark, sf):
    return B.in_region(V(spark, sf, "live_states"), "Europe").select(*LIVE_COLS.split(", "))


@query("B18_in_region_box", f"SELECT {LIVE_COLS} FROM live_states WHERE latitude BETWEEN -23.7 AND 40.0 "
                            "AND longitude BETWEEN -46.9 AND 10.5", ("live_states",))
def q_b18b(spark, sf):
    return B.in_region(V(spark, sf, "live_states"), "europe", box=(-23.7, -46.9, 40.0, 10.5)).select(*LIVE_COLS.split(", "))


@query("B19_by_icao_prefix", "SELECT event_id, icao24 FROM live_states WHERE origin_country = 'Brazil'", ("live_states",))
def q_b19(spark, sf):
    return L.by_icao_prefix(V(spark, sf, "live_states"), "sbgr").select("event_id", "icao24")


@query("B20_by_aircraft", "SELECT event_id, icao24 FROM live_states WHERE lower(trim(icao24)) = '000042'", ("live_states",))
def q_b20(spark, sf):
    return B.by_aircraft(V(spark, sf, "live_states"), " 000042 ").select("event_id", "icao24")


@query("H18_live_units", """
SELECT event_id, NULLIF(trim(callsign), '') AS callsign, CAST(round(CAST(true_track AS DECIMAL(38,9)), 1) AS DOUBLE) AS heading,
  CAST(round(CAST(velocity AS DECIMAL(38,9)) * CAST(3.6 AS DECIMAL(4,1)), 1) AS DOUBLE) AS speed_kmh,
  CAST(round(CAST(baro_altitude AS DECIMAL(38,9)) * CAST(3.28084 AS DECIMAL(10,5)), 0) AS DOUBLE) AS altitude_ft
FROM live_states""", ("live_states",))
def q_h18(spark, sf):
    return L.live_units(V(spark, sf, "live_states")).select("event_id", "callsign", "heading", "speed_kmh", "altitude_ft")


@query("H19_flight_phase", """
SELECT event_id, CASE WHEN vertical_rate * 196.850393700787 > 100 THEN 'climbing'
  WHEN vertical_rate * 196.850393700787 < -100 THEN 'descending' ELSE 'level' END AS phase FROM live_states""",
       ("live_states",))
def q_h19(spark, sf):
    return V(spark, sf, "live_states").select("event_id", L.flight_phase("vertical_rate").alias("phase"))


_MAP_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in L.CALLSIGN_AIRLINE.items()) + "}"


@query("H20_callsign_airline", f"""
SELECT event_id, COALESCE({_MAP_SQL}[upper(trim(regexp_replace(callsign, '[0-9]', '', 'g')))], '') AS airline_code,
  upper(trim(COALESCE(CAST(user_id AS VARCHAR), '') || COALESCE(CAST(event_id AS VARCHAR), ''))) AS scheduled_callsign
FROM live_states JOIN events USING (event_id)""", ("live_states",))
def q_h20(spark, sf):
    ls = V(spark, sf, "live_states").join(spark.table("events").select("event_id", "user_id"), "event_id")
    return ls.select("event_id", L.callsign_airline("callsign").alias("airline_code"),
                     L.scheduled_callsign("user_id", "event_id").alias("scheduled_callsign"))


@query("C8_merge_catalog", """
WITH s AS (SELECT cs, arg_min(country, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS country FROM (
    SELECT upper(trim(AIRLINE || CAST(FLIGHT_NUMBER AS VARCHAR))) AS cs, concat_ws(' -> ', ORIGIN_AIRPORT, DESTINATION_AIRPORT) AS country,
      l_orderkey, l_linenumber, l_partkey, l_suppkey FROM flights) t GROUP BY cs),
l AS (SELECT cs, arg_min(origin_country, event_id) AS country FROM (
    SELECT upper(trim(callsign)) AS cs, origin_country, event_id FROM live_states) t WHERE cs <> '' GROUP BY cs)
SELECT COALESCE(l.cs, s.cs) AS callsign, COALESCE(l.country, s.country) AS country, s.cs IS NOT NULL AS in_schedule,
  l.cs IS NOT NULL AS is_live FROM s FULL OUTER JOIN l ON s.cs = l.cs""", ("flights", "live_states"))
def q_c8(spark, sf):
    f = V(spark, sf, "flights")
    sched = f.select(L.scheduled_callsign("AIRLINE", "FLIGHT_NUMBER").alias("callsign"),
                     F.concat_ws(" -> ", "ORIGIN_AIRPORT", "DESTINATION_AIRPORT").alias("country"),
                     F.struct(*KEYS).alias("__o"))
    live = V(spark, sf, "live_states").select(F.upper(F.trim("callsign")).alias("callsign"),
                                              F.col("origin_country").alias("country"), F.col("event_id").alias("__o"))
    live = live.where(F.col("callsign") != "")
    return J.merge_catalog(sched, live, "callsign", ["country"], schedule_order="__o", live_order="__o")


@query("C9_aircraft_near_airports", """
SELECT p.event_id, i.iata_code AS airport_code FROM live_states p JOIN airports_idx i
  ON abs(p.latitude - i.latitude) <= 8 AND abs(p.longitude - i.longitude) <= 8
WHERE p.latitude IS NOT NULL AND p.longitude IS NOT NULL""", ("live_states", "airports_idx"))
def q_c9(spark, sf):
    out = J.aircraft_near_airports(airports_idx(spark, sf), V(spark, sf, "live_states"), 8.0)
    return out.select("event_id", "airport_code")


@query("C10_stale_keys", """
SELECT DISTINCT icao24 FROM live_states WHERE last_contact_ts < TIMESTAMP '2024-01-30 12:00:00'
EXCEPT SELECT icao24 FROM live_states WHERE last_contact_ts >= TIMESTAMP '2024-01-30 12:00:00'""", ("live_states",))
def q_c10(spark, sf):
    ls = V(spark, sf, "live_states")
    cut = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return J.stale_keys(ls.where(F.col("last_contact_ts") < cut), ls.where(F.col("last_contact_ts") >= cut))


SEARCH_QUERIES = ["GLO10", "105", "", "glo1099", "ZZZ"]


@query("F7_search_callsigns", """
WITH c AS (SELECT DISTINCT upper(trim(callsign)) AS cs FROM live_states WHERE trim(callsign) <> ''),
q AS (SELECT * FROM (VALUES (0, 'GLO10'), (1, '105'), (2, ''), (3, 'glo1099'), (4, 'ZZZ')) v(query_id, query)),
j AS (SELECT q.query_id, c.cs, CASE WHEN upper(trim(q.query)) = '' OR starts_with(c.cs, upper(trim(q.query))) THEN 0 ELSE 1 END AS prio
  FROM q JOIN c ON upper(trim(q.query)) = '' OR contains(c.cs, upper(trim(q.query))))
SELECT query_id, callsign, rank FROM (SELECT query_id, cs AS callsign,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY prio, cs) AS INTEGER) AS rank FROM j) t WHERE rank <= 8""",
       ("live_states",))
def q_f7(spark, sf):
    cat = V(spark, sf, "live_states").select(F.upper(F.trim("callsign")).alias("callsign")).where(F.col("callsign") != "")
    qs = spark.createDataFrame(list(enumerate(SEARCH_QUERIES)), "query_id int, query string")
    return R.search_callsigns(cat, qs, 8)


# ---------------------------------------------------------------------------------------------- J (batch forms)
@query("J1_latest_positions", """
SELECT icao24, arg_max(event_id, (last_contact_ts, event_id)) AS event_id,
  strftime(max(last_contact_ts), '%Y-%m-%d %H:%M:%S.%f') AS last_contact FROM live_states GROUP BY icao24""",
       ("live_states",))
def q_j1(spark, sf):
    out = S.latest_positions_batch(V(spark, sf, "live_states"))
    return out.select("icao24", "event_id", F.date_format("last_contact_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_contact"))


@query("J2_expire_positions", """
SELECT event_id, icao24, CAST(epoch(TIMESTAMP '2024-01-30 23:59:59') - epoch(date_trunc('second', last_contact_ts)) AS BIGINT)
  AS age_seconds, CASE WHEN epoch(TIMESTAMP '2024-01-30 23:59:59') - epoch(date_trunc('second', last_contact_ts)) <= 15 THEN 'fresh'
  ELSE 'stale' END AS freshness FROM live_states
WHERE epoch(TIMESTAMP '2024-01-30 23:59:59') - epoch(date_trunc('second', last_contact_ts)) <= 300""", ("live_states",))
def q_j2(spark, sf):
    out = S.expire_positions(V(spark, sf, "live_states"), "2024-01-30 23:59:59")
    return out.select("event_id", "icao24", F.col("age_seconds").cast("long").alias("age_seconds"), "freshness")


@query("J4_traffic_counts", """
SELECT strftime(time_bucket(INTERVAL 1 hour, last_contact_ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(time_bucket(INTERVAL 1 hour, last_contact_ts) + INTERVAL 1 hour, '%Y-%m-%d %H:%M:%S') AS window_end,
  origin_country, count(DISTINCT icao24) AS aircraft FROM live_states GROUP BY 1, 2, 3""", ("live_states",))
def q_j4(spark, sf):
    out = S.traffic_counts_batch(V(spark, sf, "live_states"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "origin_country", "aircraft")


FILE_ROWS = 250_000


def _feed(spark, df, order: str, path: str, parts: int = 4) -> str:
    """A table as a feed: files that arrive one after another in the order of a column, as a source delivers them. Each
    also repeats some of its rows. A file holds about 250,000 rows. The table is read and written once, a file per range of
    the column; the files' times then say which came first. Rows without a value in the column never arrive."""
    known = df.where(F.col(order).isNotNull())
    parts = max(parts, -(-known.count() // FILE_ROWS))
    times = F.when(F.pmod(F.xxhash64(order), F.lit(10)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    known.repartitionByRange(parts, order).select("*", F.explode(times).alias("__again")).drop("__again").write.mode("append").parquet(path)
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hpath(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath().getName(), f) for f in fs.listStatus(hpath(path)) if f.getPath().getName().startswith("part-"))
    newest = max((f.getModificationTime() for _, f in files), default=0)
    for place, (_, f) in enumerate(files):  # whole seconds: some file systems keep no less
        fs.setTimes(f.getPath(), newest - 1000 * (len(files) - place), -1)
    return path


def _batch_files(files: int) -> int:
    """Files of a micro-batch: a quarter of a small feed's, up to 8 (about 2,000,000 rows, which 8 tasks read). Every batch
    costs the start of its tasks and of their state, so a feed's batches grow slower than its rows."""
    return max(1, min(8, files // 4))


def _stream_of(spark, src: str, schema):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hpath(src).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sum(f.getPath().getName().startswith("part-") for f in fs.listStatus(hpath(src)))
    return S.stream_files(spark, src, schema, max_files=_batch_files(files))


def _live_stream(spark, sf):
    live = V(spark, sf, "live_states").withColumn("last_contact_ts", F.col("last_contact_ts").cast("timestamp"))
    return _stream_of(spark, _feed(spark, live, "last_contact_ts", scratch(spark, "live-src")), live.schema)


LIVE_TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def _ts_text(c: str = "last_contact_ts"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query("J3_dedupe_states_stream", f"SELECT event_id, icao24, {LIVE_TS.format('last_contact_ts')} AS last_contact FROM live_states",
       ("live_states",))
def q_j3(spark, sf):
    out = scratch(spark, "j3-out")
    S.run_available_now(S.dedupe_states(_live_stream(spark, sf)).select("event_id", "icao24", "last_contact_ts"), out,
                        scratch(spark, "j3-ckpt"))
    return spark.read.parquet(out).select("event_id", "icao24", _ts_text().alias("last_contact"))


@query("J1_latest_positions_stream", f"""
SELECT icao24, arg_max(event_id, (last_contact_ts, event_id)) AS event_id, {LIVE_TS.format('max(last_contact_ts)')} AS last_contact
FROM live_states GROUP BY icao24""", ("live_states",))
def q_j1s(spark, sf):
    stream = _live_stream(spark, sf).select("event_id", "icao24", "last_contact_ts", "latitude", "longitude")
    log = S.ChangeLog(spark, scratch(spark, "j1-state"), ["icao24"])
    S.run_changes(S.latest_positions_stream(stream), log, scratch(spark, "j1-ckpt"))
    return log.read().select("icao24", "event_id", _ts_text().alias("last_contact"))


@query("J2_expire_positions_stream", f"""
WITH t AS (SELECT icao24, event_id, last_contact_ts, lead(last_contact_ts) OVER (PARTITION BY icao24 ORDER BY last_contact_ts, event_id) AS next,
  max(last_contact_ts) OVER () AS newest FROM live_states)
SELECT icao24, event_id, {LIVE_TS.format('last_contact_ts')} AS last_contact, 'live' AS status FROM t
UNION ALL SELECT icao24, event_id, {LIVE_TS.format('last_contact_ts')}, 'gone' FROM t
WHERE next - last_contact_ts > INTERVAL 300 SECOND OR (next IS NULL AND
  date_trunc('milliseconds', last_contact_ts) + INTERVAL 300 SECOND <= date_trunc('milliseconds', newest) - INTERVAL 60 SECOND)""",
       ("live_states",))
def q_j2s(spark, sf):
    out = scratch(spark, "j2-out")
    once = S.dedupe_states(_live_stream(spark, sf), delay="1 minute")
    once_dir = scratch(spark, "j2-once")
    S.run_available_now(once, once_dir, scratch(spark, "j2-once-ckpt"))
    stream = S.stream_files(spark, once_dir, spark.read.parquet(once_dir).schema)
    S.run_available_now(S.expire_positions_stream(stream, 300), None, scratch(spark, "j2-ckpt"), foreach_batch=_append_to(out))
    return spark.read.parquet(out).select("icao24", "event_id", _ts_text().alias("last_contact"), "status")


@query("J4_traffic_counts_stream", """
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 1 hour, '%Y-%m-%d %H:%M:%S') AS window_end,
  origin_country, count(DISTINCT icao24) AS aircraft
FROM (SELECT time_bucket(INTERVAL 1 hour, last_contact_ts) AS w, origin_country, icao24, max(last_contact_ts) OVER () AS newest FROM live_states) t
WHERE w + INTERVAL 1 hour <= date_trunc('milliseconds', newest) - INTERVAL 10 MINUTE GROUP BY w, origin_country""", ("live_states",))
def q_j4s(spark, sf):
    out = scratch(spark, "j4-out")
    S.run_available_now(S.traffic_counts(_live_stream(spark, sf)), out, scratch(spark, "j4-ckpt"))
    return spark.read.parquet(out).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "origin_country", "aircraft")


@query("J5_append_messages_stream", """
SELECT session_id, turn, role, content FROM (SELECT session_id, turn, role, content,
  row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS k FROM history) t WHERE k <= 4""", ("history",))
def q_j5(spark, sf):
    history = V(spark, sf, "history").select("session_id", "turn", "role", "content")
    src = _feed(spark, history, "turn", scratch(spark, "chat-src"), 3)
    log = S.ChangeLog(spark, scratch(spark, "j5-out"), ["session_id", "turn"])
    stream = _stream_of(spark, src, history.schema)
    S.run_changes(S.last_messages_stream(stream, 4), log, scratch(spark, "j5-ckpt"))
    return log.read().select("session_id", "turn", "role", "content")


def _append_to(path):
    def write(batch, epoch):
        batch.write.mode("append").parquet(path)
    return write


# ---------------------------------------------------------------------------------------------- K1
@query("K1_register_functions", f"""
SELECT {KEYS_SQL}, LEAST(GREATEST(CAST(floor(COALESCE(SCHEDULED_DEPARTURE, 0) / 100) AS INTEGER), 0), 23) AS dep_hour,
  CASE WHEN DAY BETWEEN 5 AND 11 THEN 'morning' WHEN DAY BETWEEN 12 AND 16 THEN 'afternoon' WHEN DAY BETWEEN 17 AND 21 THEN 'evening'
    ELSE 'night' END AS time_of_day,
  CASE WHEN MONTH IN (12, 1, 2) THEN 'winter' WHEN MONTH IN (3, 4, 5) THEN 'spring' WHEN MONTH IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season,
  ORIGIN_AIRPORT || '-' || DESTINATION_AIRPORT AS route, AIRLINE || '_' || CAST(DAY AS VARCHAR) AS airline_day,
  CAST(CASE WHEN delay_probability * 100 > 15 THEN 1 ELSE 0 END AS INTEGER) AS is_delayed,
  CAST(LEAST(GREATEST(COALESCE(SCHEDULED_DEPARTURE, 1200), 0), 2359) // 100 * 100
    + LEAST(LEAST(GREATEST(COALESCE(SCHEDULED_DEPARTURE, 1200), 0), 2359) % 100, 59) AS INTEGER) AS clamped,
  {fmt_hhmm_sql('SCHEDULED_DEPARTURE')} AS departure_text, COALESCE(CAST(SCHEDULED_DEPARTURE AS BIGINT), 9999) AS departure_key,
  {fmt_hhmm_sql('SCHEDULED_DEPARTURE')} AS clock_text,
  CASE WHEN SCHEDULED_DEPARTURE IS NULL THEN 9999 ELSE CAST(LEAST(GREATEST(SCHEDULED_DEPARTURE, 0), 2359) // 100 * 100
    + LEAST(LEAST(GREATEST(SCHEDULED_DEPARTURE, 0), 2359) % 100, 59) AS BIGINT) END AS clock_key,
  CASE WHEN delay_probability >= 0.7 THEN 'HIGH' WHEN delay_probability >= 0.4 THEN 'MEDIUM'
    WHEN delay_probability IS NOT NULL THEN 'LOW' END AS risk_level,
  CAST(delay_probability >= 0.35 AS INTEGER) AS delay_prediction,
  CAST(round(CAST(DAY AS DECIMAL(20,6)) * CAST(3.6 AS DECIMAL(2,1)), 1) AS DOUBLE) AS speed_kmh,
  CAST(round(CAST(DAY AS DECIMAL(20,6)) * CAST(3.28084 AS DECIMAL(6,5)), 0) AS DOUBLE) AS altitude_ft FROM scored""", ("scored",))
def q_k1(spark, sf):
    register_functions(spark)
    V(spark, sf, "scored")
    return spark.sql("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dep_hour(SCHEDULED_DEPARTURE) AS dep_hour,
      time_of_day(DAY) AS time_of_day, season(MONTH) AS season, route_key(ORIGIN_AIRPORT, DESTINATION_AIRPORT) AS route,
      airline_dow(AIRLINE, DAY) AS airline_day, is_delayed(delay_probability * 100) AS is_delayed, clamp_hhmm(SCHEDULED_DEPARTURE) AS clamped,
      format_hhmm(SCHEDULED_DEPARTURE) AS departure_text, departure_sort_key(SCHEDULED_DEPARTURE) AS departure_key,
      format_hhmm(format_hhmm(SCHEDULED_DEPARTURE)) AS clock_text, departure_sort_key(format_hhmm(SCHEDULED_DEPARTURE)) AS clock_key,
      risk_level(delay_probability) AS risk_level, delay_prediction(delay_probability, 0.35) AS delay_prediction,
      speed_kmh(DAY) AS speed_kmh, altitude_ft(DAY) AS altitude_ft FROM scored""")


__all__ = ["scratch"]
