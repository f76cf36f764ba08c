"""DuckDB SQL building blocks for the oracles: the fixture views plus the enriched-flights and holiday CTEs.

The driver's DuckDB only has the raw tables, so every oracle inlines what it needs as CTEs (see :func:`with_ctes`).
"""

from __future__ import annotations

import re

from skydelay.plans import fixtures as FX

EXTRA: dict[str, str] = {}
EXTRA_DEPS: dict[str, list[str]] = {}

# Observed federal holidays, rule by rule (DuckDB: isodow Monday=1 .. Sunday=7).
EXTRA["holidays"] = """
SELECT DISTINCT d AS holiday_date FROM (
  SELECT y, CASE isodow(b) WHEN 6 THEN b - 1 WHEN 7 THEN b + 1 ELSE b END AS d
  FROM (SELECT y, make_date(y, m, dd) AS b FROM (SELECT CAST(range AS INTEGER) AS y FROM range(1949, 2152)) yy,
        (VALUES (1, 1), (7, 4), (11, 11), (12, 25)) v(m, dd)) fixed
  UNION ALL
  SELECT y, CASE isodow(make_date(y, 6, 19)) WHEN 6 THEN make_date(y, 6, 19) - 1 WHEN 7 THEN make_date(y, 6, 19) + 1
         ELSE make_date(y, 6, 19) END FROM (SELECT CAST(range AS INTEGER) AS y FROM range(2021, 2152)) yy
  UNION ALL
  SELECT y, f + CAST((wd - isodow(f) + 7) % 7 AS INTEGER) + 7 * (n - 1) FROM (
    SELECT y, make_date(y, m, 1) AS f, wd, n FROM (SELECT CAST(range AS INTEGER) AS y FROM range(1949, 2152)) yy,
      (VALUES (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4)) v(m, wd, n)) nth
  UNION ALL
  SELECT y, make_date(y, 1, 1) + CAST((1 - isodow(make_date(y, 1, 1)) + 7) % 7 AS INTEGER) + 14
  FROM (SELECT CAST(range AS INTEGER) AS y FROM range(1986, 2152)) yy
  UNION ALL
  SELECT y, make_date(y, 5, 31) - CAST((isodow(make_date(y, 5, 31)) - 1 + 7) % 7 AS INTEGER)
  FROM (SELECT CAST(range AS INTEGER) AS y FROM range(1949, 2152)) yy
) h WHERE year(d) BETWEEN 1950 AND 2150
"""

# flights -> airline name, airports twice, cleaned (B1), features (H31) with the holiday flag.
EXTRA["enriched"] = """
SELECT f.*, a.AIRLINE AS AIRLINE_NAME,
  o.AIRPORT AS ORIGIN_AIRPORT_NAME, o.CITY AS ORIGIN_CITY, o.STATE AS ORIGIN_STATE,
  o.LATITUDE AS ORIGIN_LATITUDE, o.LONGITUDE AS ORIGIN_LONGITUDE,
  d.AIRPORT AS DESTINATION_AIRPORT_NAME, d.CITY AS DESTINATION_CITY, d.STATE AS DESTINATION_STATE,
  d.LATITUDE AS DESTINATION_LATITUDE, d.LONGITUDE AS DESTINATION_LONGITUDE,
  CASE WHEN hr BETWEEN 5 AND 11 THEN 'morning' WHEN hr BETWEEN 12 AND 16 THEN 'afternoon'
       WHEN hr BETWEEN 17 AND 21 THEN 'evening' ELSE 'night' END AS TIME_OF_DAY,
  CASE WHEN f.MONTH IN (12, 1, 2) THEN 'winter' WHEN f.MONTH IN (3, 4, 5) THEN 'spring'
       WHEN f.MONTH IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS SEASON,
  f.ORIGIN_AIRPORT || '-' || f.DESTINATION_AIRPORT AS ROUTE,
  f.AIRLINE || '_' || CAST(f.DAY_OF_WEEK AS VARCHAR) AS AIRLINE_DOW,
  CAST(CASE WHEN f.ARRIVAL_DELAY > 15 THEN 1 ELSE 0 END AS INTEGER) AS IS_DELAYED,
  CAST(CASE WHEN h.holiday_date IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS IS_HOLIDAY
FROM (SELECT *, LEAST(GREATEST(CAST(floor(COALESCE(SCHEDULED_DEPARTURE, 0) / 100) AS INTEGER), 0), 23) AS hr,
             try_cast(printf('%04d-%02d-%02d', YEAR, MONTH, DAY) AS DATE) AS fdate
      FROM flights WHERE CANCELLED IS DISTINCT FROM 1 AND ARRIVAL_DELAY IS NOT NULL AND ARRIVAL_DELAY <= 500) f
LEFT JOIN airlines a ON f.AIRLINE = a.IATA_CODE
LEFT JOIN airports_raw o ON f.ORIGIN_AIRPORT = o.IATA_CODE
LEFT JOIN airports_raw d ON f.DESTINATION_AIRPORT = d.IATA_CODE
LEFT JOIN holidays h ON f.fdate = h.holiday_date
"""
EXTRA_DEPS["enriched"] = ["flights", "airlines", "airports_raw", "holidays"]

# Deterministic 80/20 split per class by md5(seed|key) (E1).
EXTRA["split"] = """
SELECT e.*, rn <= CAST(floor(cnt * 0.8) AS BIGINT) AS is_train FROM (
  SELECT *, row_number() OVER (PARTITION BY IS_DELAYED ORDER BY hk) AS rn, count(*) OVER (PARTITION BY IS_DELAYED) AS cnt
  FROM (SELECT *, md5('42|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|'
                      || CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)) AS hk FROM enriched) x) e
"""
EXTRA_DEPS["split"] = ["enriched"]

# Target-encoding rates from train rows only (D2, long form).
EXTRA["rates"] = """
SELECT 'ORIGIN_DELAY_RATE' AS rate, ORIGIN_AIRPORT AS key, avg(IS_DELAYED) AS value, count(*) AS n FROM split WHERE is_train AND ORIGIN_AIRPORT IS NOT NULL GROUP BY 2
UNION ALL SELECT 'DEST_DELAY_RATE', DESTINATION_AIRPORT, avg(IS_DELAYED), count(*) FROM split WHERE is_train AND DESTINATION_AIRPORT IS NOT NULL GROUP BY 2
UNION ALL SELECT 'CARRIER_DELAY_RATE', AIRLINE, avg(IS_DELAYED), count(*) FROM split WHERE is_train AND AIRLINE IS NOT NULL GROUP BY 2
UNION ALL SELECT 'ROUTE_DELAY_RATE', ROUTE, avg(IS_DELAYED), count(*) FROM split WHERE is_train AND ROUTE IS NOT NULL GROUP BY 2
UNION ALL SELECT 'CARRIER_DELAY_RATE_DOW', AIRLINE_DOW, avg(IS_DELAYED), count(*) FROM split WHERE is_train AND AIRLINE_DOW IS NOT NULL GROUP BY 2
"""
EXTRA_DEPS["rates"] = ["split"]

EXTRA["grate"] = "SELECT avg(IS_DELAYED) AS global_rate FROM split WHERE is_train"
EXTRA_DEPS["grate"] = ["split"]

# flights_processed: every cleaned row with its five rates (C4).
EXTRA["processed"] = """
SELECT e.*,
  COALESCE(r1.value, g.global_rate) AS ORIGIN_DELAY_RATE, COALESCE(r2.value, g.global_rate) AS DEST_DELAY_RATE,
  COALESCE(r3.value, g.global_rate) AS CARRIER_DELAY_RATE, COALESCE(r4.value, g.global_rate) AS ROUTE_DELAY_RATE,
  COALESCE(r5.value, g.global_rate) AS CARRIER_DELAY_RATE_DOW
FROM split e CROSS JOIN grate g
LEFT JOIN rates r1 ON r1.rate = 'ORIGIN_DELAY_RATE' AND r1.key = e.ORIGIN_AIRPORT
LEFT JOIN rates r2 ON r2.rate = 'DEST_DELAY_RATE' AND r2.key = e.DESTINATION_AIRPORT
LEFT JOIN rates r3 ON r3.rate = 'CARRIER_DELAY_RATE' AND r3.key = e.AIRLINE
LEFT JOIN rates r4 ON r4.rate = 'ROUTE_DELAY_RATE' AND r4.key = e.ROUTE
LEFT JOIN rates r5 ON r5.rate = 'CARRIER_DELAY_RATE_DOW' AND r5.key = e.AIRLINE_DOW
"""
EXTRA_DEPS["processed"] = ["split", "rates", "grate"]

EXTRA["slim"] = """
SELECT YEAR AS year, MONTH AS month, DAY AS day, ARRIVAL_DELAY AS arrival_delay, IS_DELAYED AS is_delayed,
  AIRLINE_NAME AS airline_name, AIRLINE AS airline, ORIGIN_STATE AS origin_state FROM enriched
"""
EXTRA_DEPS["slim"] = ["enriched"]

# Normalized airports index (B15).
EXTRA["airports_idx"] = """
SELECT iata_code, airport_name, city, state, country, latitude, longitude FROM (
  SELECT *, row_number() OVER (PARTITION BY iata_code ORDER BY src_order) AS rn FROM (
    SELECT upper(nz(IATA_CODE)) AS iata_code, nz(AIRPORT) AS airport_name, nz(CITY) AS city, nz(STATE) AS state,
      nz(COUNTRY) AS country, try_cast(CAST(LATITUDE AS VARCHAR) AS DOUBLE) AS latitude,
      try_cast(CAST(LONGITUDE AS VARCHAR) AS DOUBLE) AS longitude, src_order
    FROM airports_raw) c
  WHERE regexp_full_match(iata_code, '[A-Z0-9]{3}') AND country IS NOT NULL) r WHERE rn = 1
"""
EXTRA_DEPS["airports_idx"] = ["airports_raw"]

def nz(x: str) -> str:
    """DuckDB: trimmed text with the missing-value markers ('', 'None', 'nan', backslash-N) -> NULL."""
    t = f"trim(CAST({x} AS VARCHAR))"
    return f"CASE WHEN {t} IN ('', 'None', 'nan', '\\N') THEN NULL ELSE {t} END"


for _k in list(EXTRA):
    EXTRA[_k] = re.sub(r"nz\(([A-Za-z_]+)\)", lambda m: nz(m.group(1)), EXTRA[_k])

ORDER = ["holidays", "enriched", "split", "rates", "grate", "processed", "slim", "airports_idx"]


def _closure(names: list[str]) -> tuple[set[str], set[str]]:
    views: set[str] = set()
    extras: set[str] = set()
    stack = list(names)
    while stack:
        n = stack.pop()
        if n in FX.VIEWS:
            if n not in views:
                views.add(n)
                stack.extend(FX.DEPENDS.get(n, []))
        elif n in EXTRA:
            if n not in extras:
                extras.add(n)
                stack.extend(EXTRA_DEPS.get(n, []))
        else:
            raise KeyError(n)
    return views, extras


def with_ctes(names: list[str], body: str) -> str:
    """``WITH <fixture views and extra blocks needed by names, in dependency order> body``."""
    views, extras = _closure(names)
    parts = [f"{v} AS (\n{FX.view_sql(v, 'duckdb')}\n)" for v in FX.ORDER if v in views]
    parts += [f"{e} AS (\n{EXTRA[e].strip()}\n)" for e in ORDER if e in extras]
    body = body.strip()
    if not parts:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
