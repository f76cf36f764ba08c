"""Views that give the generic test tables (TPC-H-like parquet) the shapes the delay operators expect.

Each view is one SQL block shared by Spark and DuckDB; the ``{DOW}`` slot is the only engine-specific piece.
Spark builds them with ``spark.sql`` over temp views of the parquet files; the DuckDB oracles inline the same
blocks as CTEs (see :func:`cte_prefix`). See FIXTURES.md for the check values of every view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

DOW = {"spark": "(weekday(l_shipdate) + 1)", "duckdb": "isodow(l_shipdate)"}

# Fixed inputs of the fixtures (FIXTURES.md §2).
AS_OF_FUTURE = "2001-10-01"
AS_OF_NONE = "2030-01-01"
SEED = 42

VIEWS: dict[str, str] = {}

VIEWS["flights"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(year(l_shipdate) AS INT) AS YEAR, CAST(month(l_shipdate) AS INT) AS MONTH, CAST(day(l_shipdate) AS INT) AS DAY,
  CAST({DOW} AS INT) AS DAY_OF_WEEK,
  p_brand AS AIRLINE, CAST(l_orderkey % 9000 AS INT) AS FLIGHT_NUMBER,
  'N' || lpad(CAST(c_nationkey AS VARCHAR(3)), 2, '0') AS ORIGIN_AIRPORT,
  CASE WHEN l_suppkey % 53 = 0 THEN NULL ELSE 'N' || lpad(CAST(s_nationkey AS VARCHAR(3)), 2, '0') END AS DESTINATION_AIRPORT,
  CAST(CASE WHEN l_orderkey % 211 = 0 THEN 2515 WHEN l_orderkey % 101 = 0 THEN NULL
       ELSE ((l_partkey * 37 + l_linenumber * 101) % 24) * 100 + (l_suppkey % 60) END AS INT) AS SCHEDULED_DEPARTURE,
  CAST(c_nationkey * 97 + s_nationkey * 31 + l_linenumber AS DOUBLE) AS DISTANCE,
  CASE WHEN l_orderkey % 83 = 0 THEN NULL WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN l_quantity + 480
       ELSE l_quantity - 25 END AS ARRIVAL_DELAY,
  CAST(CASE WHEN l_orderkey % 67 = 0 THEN NULL WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END AS INT) AS CANCELLED,
  CASE WHEN l_quantity > 40 THEN l_quantity - 40 END AS WEATHER_DELAY,
  CASE WHEN l_quantity > 45 THEN l_quantity - 45 END AS LATE_AIRCRAFT_DELAY
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
"""

VIEWS["airports_raw"] = """
SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR(3)), 2, '0') AS IATA_CODE, n_name || ' Intl Airport' AS AIRPORT,
  CASE WHEN n_nationkey % 9 = 4 THEN chr(92) || 'N' ELSE 'City ' || CAST(n_nationkey % 12 AS VARCHAR(3)) END AS CITY,
  CASE WHEN n_nationkey % 7 = 3 THEN '' ELSE 'S' || CAST(n_nationkey % 5 AS VARCHAR(3)) END AS STATE, r_name AS COUNTRY,
  CAST(n_nationkey * 7 - 84 AS DOUBLE) AS LATITUDE, CAST(n_nationkey * 14 - 170 AS DOUBLE) AS LONGITUDE,
  n_nationkey AS src_order
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'n03', 'Duplicate', 'Other', 'S9', 'EUROPE', CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), 100
UNION ALL SELECT 'TOOLONG', 'Bad code', 'Other', 'S9', 'EUROPE', CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), 101
"""

VIEWS["airlines"] = """
SELECT p_brand AS IATA_CODE, 'Air ' || p_brand AS AIRLINE FROM part GROUP BY p_brand
"""

VIEWS["scored"] = """
SELECT f.*, ((l_partkey * 31 + l_orderkey * 17 + l_linenumber * 7) % 1000) / 1000.0E0 AS delay_probability FROM flights f
"""

VIEWS["predictions"] = """
SELECT YEAR, MONTH, DAY, AIRLINE, FLIGHT_NUMBER, ORIGIN_AIRPORT, DESTINATION_AIRPORT, delay_probability,
  CAST(CASE WHEN delay_probability >= 0.5E0 THEN 1 ELSE 0 END AS INT) AS delay_prediction
FROM scored WHERE l_partkey % 3 <> 0
"""

VIEWS["actuals"] = """
SELECT YEAR, MONTH, DAY, AIRLINE, FLIGHT_NUMBER, ORIGIN_AIRPORT, DESTINATION_AIRPORT, ARRIVAL_DELAY,
  CAST(CASE WHEN ARRIVAL_DELAY > 15 THEN 1 ELSE 0 END AS INT) AS IS_DELAYED
FROM flights WHERE ARRIVAL_DELAY <= 500 AND CANCELLED IS DISTINCT FROM 1
"""

VIEWS["requests"] = """
SELECT o_orderkey AS request_id, 'N' || lpad(CAST(c_nationkey AS VARCHAR(3)), 2, '0') AS origin_airport,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'N' || lpad(CAST(o_custkey % 25 AS VARCHAR(3)), 2, '0') END AS destination_airport,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Brand#' || CAST(1 + o_orderkey % 25 AS VARCHAR(3)) END AS airline,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 30) * 100 + o_orderkey % 70 END AS INT) AS scheduled_departure,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN month(o_orderdate) END AS INT) AS month,
  CAST(CASE WHEN o_orderkey % 13 = 0 THEN year(o_orderdate) END AS INT) AS year,
  CAST(CASE WHEN o_orderkey % 10 = 0 THEN 1 + o_orderkey % 28 END AS INT) AS day,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN 1 + o_orderkey % 7 END AS INT) AS day_of_week,
  CASE WHEN o_orderkey % 6 = 1 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) END AS flight_date,
  CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_orderkey % 3000 AS DOUBLE) END AS distance
FROM orders JOIN customer ON o_custkey = c_custkey
"""

VIEWS["questions"] = """
SELECT o_orderkey AS request_id,
 CASE o_orderkey % 6 WHEN 0 THEN 'saindo de ' || n.n_name || ' para N' || lpad(CAST(o_custkey % 25 AS VARCHAR(3)), 2, '0')
  WHEN 1 THEN 'N' || lpad(CAST(c_nationkey AS VARCHAR(3)), 2, '0') || ' -> N' || lpad(CAST(o_custkey % 25 AS VARCHAR(3)), 2, '0')
  WHEN 2 THEN 'de City ' || CAST(c_nationkey % 12 AS VARCHAR(3)) || ' para ' || r_name || ', risco de atraso?'
  WHEN 3 THEN 'best price to ' || r_name WHEN 4 THEN 'complete travel guide for ' || r_name ELSE '' END AS question
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n.n_nationkey
JOIN region ON n.n_regionkey = r_regionkey
"""

VIEWS["history"] = """
SELECT conv_id AS session_id, turn, role,
  CASE WHEN conv_id % 17 = 0 AND role = 'assistant' THEN 'Hello, I am the assistant. ' || text
       WHEN conv_id % 13 = 0 AND role = 'assistant' THEN '<think>draft</think> ' || text ELSE text END AS content,
  CASE WHEN role = 'assistant' AND conv_id % 17 = 0 THEN 'system' WHEN role = 'assistant' THEN 'heuristic' END AS advice_source,
  CASE WHEN (conv_id + turn) % 3 = 0 THEN 'N' || lpad(CAST((conv_id + turn) % 25 AS VARCHAR(3)), 2, '0') END AS origin_airport,
  CASE WHEN (conv_id + turn) % 3 = 0 THEN 'AMERICA' END AS origin_country,
  CASE WHEN (conv_id * 2 + turn) % 4 = 1 THEN 'N' || lpad(CAST((conv_id + turn * 3) % 25 AS VARCHAR(3)), 2, '0') END AS destination_airport,
  CASE WHEN (conv_id * 2 + turn) % 4 <= 1 THEN 'ASIA' END AS destination_country
FROM conversations
"""

VIEWS["live_states"] = """
SELECT event_id, lpad(CAST(user_id AS VARCHAR(6)), 6, '0') AS icao24,
  CASE WHEN user_id % 10 = 0 THEN '  ' ELSE 'GLO' || CAST(1000 + user_id AS VARCHAR(6)) || ' ' END AS callsign,
  CASE user_id % 5 WHEN 0 THEN 'Brazil' WHEN 1 THEN 'France' WHEN 2 THEN 'Germany' WHEN 3 THEN 'United States'
       ELSE 'United Kingdom' END AS origin_country,
  ts AS last_contact_ts,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE CAST((event_id * 53) % 360 - 180 AS DOUBLE) END AS longitude,
  CAST((event_id * 37) % 180 - 90 AS DOUBLE) AS latitude, CAST(value AS DECIMAL(12,2)) * 25 AS baro_altitude,
  event_type = 'error' AS on_ground, CAST(value AS DECIMAL(12,2)) AS velocity,
  CAST((event_id * 7) % 360 AS DOUBLE) AS true_track, CAST((event_id % 41) - 20 AS DOUBLE) AS vertical_rate
FROM events
"""

VIEWS["state_json"] = """
SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'not json'
  WHEN event_id % 10 = 0 THEN '["' || icao24 || '","' || callsign || '","' || origin_country || '"]'
  ELSE '["' || icao24 || '","' || callsign || '","' || origin_country || '",null,' || CAST(event_id AS VARCHAR(10))
    || ',' || CAST(event_id % 180 AS VARCHAR(4)) || ',' || CAST(event_id % 90 AS VARCHAR(4)) || ',1000,false,200,90,0]' END AS raw
FROM live_states
"""

# Which views each view reads (to inline the needed CTEs in dependency order).
DEPENDS = {
    "scored": ["flights"],
    "predictions": ["flights", "scored"],
    "actuals": ["flights"],
    "state_json": ["live_states"],
}
ORDER = list(VIEWS)


def view_sql(name: str, engine: str) -> str:
    return VIEWS[name].replace("{DOW}", DOW[engine]).strip()


_STATE: dict[int, dict] = {}


def _state(spark: SparkSession, sf_dir: str) -> dict:
    """Per-session registry: which scale factor the temp views point at and the view DataFrames built so far."""
    key = id(spark._jsparkSession)
    st = _STATE.get(key)
    if st is None or st["sf"] != sf_dir:
        st = {"sf": sf_dir, "raw": set(), "views": {}}
        _STATE[key] = st
    return st


def register_raw(spark: SparkSession, sf_dir: str, tables=RAW_TABLES) -> None:
    """Temp views over the parquet tables of one scale factor (re-pointed when ``sf_dir`` changes)."""
    st = _state(spark, sf_dir)
    for t in tables:
        if t not in st["raw"]:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
            st["raw"].add(t)


def _raw_refs(sql: str) -> list[str]:
    return [t for t in RAW_TABLES if re.search(rf"\b{t}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """DataFrame of one fixture view over the tables in ``sf_dir``."""
    st = _state(spark, sf_dir)
    if name in st["views"]:
        return st["views"][name]
    for dep in DEPENDS.get(name, []):
        view(spark, sf_dir, dep)
    sql = view_sql(name, "spark")
    register_raw(spark, sf_dir, _raw_refs(sql))
    df = spark.sql(sql)
    df.createOrReplaceTempView(name)
    st["views"][name] = df
    return df


def cte_prefix(names: list[str]) -> str:
    """``WITH a AS (...), b AS (...)`` for DuckDB, including the views those views read."""
    wanted: set[str] = set()
    for n in names:
        wanted.add(n)
        wanted.update(DEPENDS.get(n, []))
    parts = [f"{v} AS (\n{view_sql(v, 'duckdb')}\n)" for v in ORDER if v in wanted]
    return "WITH " + ",\n".join(parts) + "\n"
