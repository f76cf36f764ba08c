"""Joins (survey §2.C).

Dimension lookups are plain equi joins without hints: Spark's planner broadcasts a side whose estimated size is under
``spark.sql.autoBroadcastJoinThreshold`` and AQE re-plans at runtime from the measured size, so a dimension that
grows past the threshold falls back to a shuffle join instead of failing. Only tables whose size is fixed by
construction (a few dozen rows of fixed values) are broadcast explicitly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skydelay.functions import exprs as X


# C1 -----------------------------------------------------------------------------------------------
def join_airline(flights: DataFrame, airlines: DataFrame, code: str = "AIRLINE", dim_code: str = "IATA_CODE",
                 dim_name: str = "AIRLINE", out: str = "AIRLINE_NAME") -> DataFrame:
    """Left equi join: airline code -> display name."""
    dim = airlines.select(F.col(dim_code).alias("__code"), F.col(dim_name).alias(out))
    return flights.join(dim, flights[code] == dim["__code"], "left").drop("__code")


# C2 -----------------------------------------------------------------------------------------------
AIRPORT_ATTRS = {"AIRPORT": "AIRPORT_NAME", "CITY": "CITY", "STATE": "STATE", "LATITUDE": "LATITUDE",
                 "LONGITUDE": "LONGITUDE"}  # fixed values: airport column -> suffix of the prefixed output


def join_airports(flights: DataFrame, airports: DataFrame, origin: str = "ORIGIN_AIRPORT",
                  dest: str = "DESTINATION_AIRPORT", code: str = "IATA_CODE") -> DataFrame:
    """The same dimension joined twice (origin, destination), five prefixed attributes each."""
    out = flights
    for side, key in (("ORIGIN", origin), ("DESTINATION", dest)):
        dim = airports.select(F.col(code).alias(f"__{side}"),
                              *[F.col(src).alias(f"{side}_{suffix}") for src, suffix in AIRPORT_ATTRS.items()])
        out = out.join(dim, out[key] == dim[f"__{side}"], "left").drop(f"__{side}")
    return out


# C3 -----------------------------------------------------------------------------------------------
PROFILE_AIRPORT_COLUMNS = ("IATA_CODE", "AIRPORT", "CITY", "STATE", "COUNTRY", "LATITUDE", "LONGITUDE")


def airport_profiles(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Airports left-join origin statistics left-join destination statistics; airports without flights keep nulls."""
    from skydelay.operators.stats import destination_stats, origin_stats
    o = origin_stats(flights).withColumnRenamed("ORIGIN_AIRPORT", "__o")
    d = destination_stats(flights).withColumnRenamed("DESTINATION_AIRPORT", "__d")
    base = airports.select(*[c for c in PROFILE_AIRPORT_COLUMNS if c in airports.columns])
    out = base.join(o, base["IATA_CODE"] == o["__o"], "left").drop("__o")
    return out.join(d, out["IATA_CODE"] == d["__d"], "left").drop("__d")


# C4 -----------------------------------------------------------------------------------------------
RATE_KEYS = {  # fixed values: rate column -> key column it is looked up by
    "ORIGIN_DELAY_RATE": "ORIGIN_AIRPORT",
    "DEST_DELAY_RATE": "DESTINATION_AIRPORT",
    "CARRIER_DELAY_RATE": "AIRLINE",
    "ROUTE_DELAY_RATE": "ROUTE",
    "CARRIER_DELAY_RATE_DOW": "AIRLINE_DOW",
}


def apply_rates(df: DataFrame, rates: DataFrame, global_rate) -> DataFrame:
    """Five lookups (rates in long form: rate, key, value); an unseen or null key gets the global rate.

    ``global_rate`` is a number or a scalar Column (e.g. ``global_rate_df.scalar()``)."""
    g = global_rate if not isinstance(global_rate, (int, float)) else F.lit(float(global_rate))
    out = df
    for rate, key in RATE_KEYS.items():
        dim = rates.where(F.col("rate") == rate).select(F.col("key").alias(f"__k_{rate}"), F.col("value").alias(f"__v_{rate}"))
        out = out.join(dim, out[key] == dim[f"__k_{rate}"], "left")
        out = out.withColumn(rate, F.coalesce(F.col(f"__v_{rate}"), g)).drop(f"__k_{rate}", f"__v_{rate}")
    return out


# C5 -----------------------------------------------------------------------------------------------
MATCH_KEYS = ("YEAR", "MONTH", "DAY", "AIRLINE", "ORIGIN_AIRPORT", "DESTINATION_AIRPORT")


def _norm_key(df: DataFrame, c: str):
    """Numeric-looking keys compare as numbers, other keys as text (numeric columns skip the text test)."""
    if dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or \
            dict(df.dtypes)[c].startswith("decimal"):
        return F.col(c).cast("double").cast("string")
    text = F.trim(F.col(c).cast("string"))
    return F.coalesce(X.text_to_double(text).cast("string"), text)


def match_actuals(pred: DataFrame, actual: DataFrame, target: str = "IS_DELAYED", delay: str = "ARRIVAL_DELAY") -> DataFrame:
    """Inner equi join of predictions and actuals on Y, M, D, airline, origin, destination (+ flight number when both
    have it); adds actual_is_delayed and actual_arrival_delay."""
    keys = list(MATCH_KEYS) + (["FLIGHT_NUMBER"] if "FLIGHT_NUMBER" in pred.columns and "FLIGHT_NUMBER" in actual.columns else [])
    a = actual.select(*[_norm_key(actual, k).alias(f"__a_{k}") for k in keys],
                      F.col(target).alias("actual_is_delayed"), F.col(delay).alias("actual_arrival_delay"))
    p = pred.withColumns({f"__p_{k}": _norm_key(pred, k) for k in keys})
    cond = [p[f"__p_{k}"] == a[f"__a_{k}"] for k in keys]
    return p.join(a, cond, "inner").drop(*[f"__p_{k}" for k in keys], *[f"__a_{k}" for k in keys])


# C6 -----------------------------------------------------------------------------------------------
def lookup_airport(df: DataFrame, airports: DataFrame, code_col: str, prefix: str) -> DataFrame:
    """Code -> country, city, name and a label 'city, country' (else the first available part).

    ``airports`` is the normalized index (B15): one row per code."""
    dim = airports.select(F.col("iata_code").alias(f"__{prefix}"), F.col("country").alias(f"{prefix}_country"),
                          F.col("city").alias(f"{prefix}_city"), F.col("airport_name").alias(f"{prefix}_airport_name"))
    out = df.join(dim, X.code_text(code_col) == dim[f"__{prefix}"], "left").drop(f"__{prefix}")
    city, country, name = F.col(f"{prefix}_city"), F.col(f"{prefix}_country"), F.col(f"{prefix}_airport_name")
    label = F.when(city.isNotNull() & country.isNotNull(), F.concat(city, F.lit(", "), country)) \
        .otherwise(F.coalesce(city, country, name))
    return out.withColumn(f"{prefix}_label", label)


# C7 -----------------------------------------------------------------------------------------------
def hour_grid(df: DataFrame, dep: str = "SCHEDULED_DEPARTURE", out: str = "slot_departure") -> DataFrame:
    """Rows without a departure fan out to the 24 slots 0, 100, ..., 2300; rows with one keep it (generate, not join)."""
    slots = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: h * 100)
    return df.withColumn(out, F.explode(F.when(F.col(dep).isNull(), slots).otherwise(F.array(F.col(dep).cast("int")))))


# C8 -----------------------------------------------------------------------------------------------
def merge_catalog(schedule: DataFrame, live: DataFrame, key: str = "callsign", fields: Sequence[str] = (),
                  schedule_order: str | None = None, live_order: str | None = None) -> DataFrame:
    """Full outer join by callsign: live fields override, schedule fields stay where live has none. First row per
    callsign on each side (by the given order columns). Output sorted by callsign."""
    from skydelay.operators.ranking import keep_first
    s = keep_first(schedule.where(F.col(key).isNotNull()), [key], [F.col(schedule_order)] if schedule_order else [])
    lv = keep_first(live.where(F.col(key).isNotNull()), [key], [F.col(live_order)] if live_order else [])
    s = s.select(F.col(key).alias("__sk"), *[F.col(f).alias(f"__s_{f}") for f in fields if f in schedule.columns])
    lv = lv.select(F.col(key).alias("__lk"), *[F.col(f).alias(f"__l_{f}") for f in fields if f in live.columns])
    j = s.join(lv, s["__sk"] == lv["__lk"], "full_outer")
    cols = [F.coalesce(F.col("__lk"), F.col("__sk")).alias(key)]
    for f in fields:
        parts = [F.col(f"__l_{f}")] if f in live.columns else []
        parts += [F.col(f"__s_{f}")] if f in schedule.columns else []
        cols.append(F.coalesce(*parts).alias(f) if len(parts) > 1 else parts[0].alias(f))
    cols.append(F.col("__sk").isNotNull().alias("in_schedule"))
    cols.append(F.col("__lk").isNotNull().alias("is_live"))
    return j.select(*cols).orderBy(key)


# C9 -----------------------------------------------------------------------------------------------
def aircraft_near_airports(airports: DataFrame, positions: DataFrame, deg: float = 8.0, code: str = "iata_code",
                           lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Range join: every (airport, aircraft) with |lat diff| <= deg and |lon diff| <= deg (ground included).

    Grid-bucket equi join: each aircraft is keyed to its deg x deg cell, each airport is replicated to the (at most 3x3)
    cells its box touches; the exact ``between`` runs as the residual. No nested-loop join, and each aircraft row is
    shuffled once."""
    cell = float(deg)
    ap = airports.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(code).alias("airport_code"), F.col(lat).alias("airport_latitude"), F.col(lon).alias("airport_longitude"))
    lat_lo = F.floor((F.col("airport_latitude") - cell) / cell)
    lat_hi = F.floor((F.col("airport_latitude") + cell) / cell)
    lon_lo = F.floor((F.col("airport_longitude") - cell) / cell)
    lon_hi = F.floor((F.col("airport_longitude") + cell) / cell)
    ap = ap.withColumn("__gy", F.explode(F.sequence(lat_lo, lat_hi))).withColumn("__gx", F.explode(F.sequence(lon_lo, lon_hi)))
    pos = positions.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()) \
        .withColumn("__gy", F.floor(F.col(lat) / cell)).withColumn("__gx", F.floor(F.col(lon) / cell))
    j = pos.join(ap, ["__gy", "__gx"], "inner")
    hit = (F.abs(F.col(lat) - F.col("airport_latitude")) <= deg) & (F.abs(F.col(lon) - F.col("airport_longitude")) <= deg)
    return j.where(hit).drop("__gy", "__gx")


# C10 ----------------------------------------------------------------------------------------------
def stale_keys(prev: DataFrame, current: DataFrame, key: str = "icao24") -> DataFrame:
    """Keys present before and no longer present (anti join)."""
    return prev.select(key).distinct().join(current.select(key), key, "left_anti")
