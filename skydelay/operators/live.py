"""Live aircraft positions: state-vector parsing, units, phases, callsign airlines and coarse filters
(survey A7, B17-B20, H18-H20). Batch forms; the streaming jobs in :mod:`skydelay.streaming.live` reuse them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skydelay.functions import exprs as X

# The 17 positional fields of a state vector and their types.
STATE_FIELDS = [
    ("icao24", "string"), ("callsign", "string"), ("origin_country", "string"), ("time_position", "bigint"),
    ("last_contact", "bigint"), ("longitude", "double"), ("latitude", "double"), ("baro_altitude", "double"),
    ("on_ground", "boolean"), ("velocity", "double"), ("true_track", "double"), ("vertical_rate", "double"),
    ("sensors", "string"), ("geo_altitude", "double"), ("squawk", "string"), ("spi", "boolean"),
    ("position_source", "int"),
]

# Airport-code prefix -> country (coarse live filter); the prefix mapped to the wrong country is left out.
ICAO_PREFIX_COUNTRY = {"SB": "Brazil", "EG": "United Kingdom", "LF": "France", "ED": "Germany", "K": "United States"}

# Three-letter callsign prefix -> two-letter airline code.
CALLSIGN_AIRLINE = {
    "GLO": "G3", "TAM": "JJ", "LAM": "JJ", "AZU": "AD", "VOE": "V7", "ONE": "2Z", "MAP": "7M", "DAL": "DL",
    "UAL": "UA", "AAL": "AA", "BAW": "BA", "AFR": "AF", "KLM": "KL", "IBE": "IB", "LAN": "LA", "TAP": "TP",
    "DLH": "LH", "RYR": "FR", "EZY": "U2", "SWR": "LX",
}


# A7 -----------------------------------------------------------------------------------------------
def parse_state_vectors(df: DataFrame, col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON positional array -> one typed column per field; short arrays padded with null, malformed rows skipped.
    ``from_json`` runs in the JVM (no Python per row)."""
    arr = F.from_json(F.col(col), "array<string>")
    parsed = df.select(*keep, arr.alias("__a")).where(F.col("__a").isNotNull())
    cols = []
    for i, (name, typ) in enumerate(STATE_FIELDS):
        v = F.get(F.col("__a"), i)
        cols.append((v if typ == "string" else v.try_cast(typ)).alias(name))
    return parsed.select(*keep, *cols)


# H18 ----------------------------------------------------------------------------------------------
def live_units(df: DataFrame) -> DataFrame:
    """callsign trimmed (blank -> null); heading 1 dp; km/h = m/s x 3.6 (1 dp); feet = m x 3.28084 (0 dp).
    Rounding is half-up on decimals (independent of binary float noise)."""
    return df.withColumns({
        "callsign": X.blank_to_null("callsign"),
        "heading": X.round_half_up("true_track", 1),
        "speed_kmh": X.kmh("velocity"),
        "altitude_ft": X.feet("baro_altitude"),
    })


# H19 ----------------------------------------------------------------------------------------------
def flight_phase(vertical_rate_ms) -> Column:
    """Vertical rate (m/s) -> ft/min; > 100 climbing, < -100 descending, otherwise (or null) level."""
    fpm = X.col(vertical_rate_ms) * F.lit(196.850393700787)
    return F.when(fpm > 100, "climbing").when(fpm < -100, "descending").otherwise("level")


# H20 ----------------------------------------------------------------------------------------------
def callsign_airline(callsign) -> Column:
    """Digits removed, trimmed, upper-cased callsign -> airline code via the fixed map (no match -> '')."""
    letters = F.upper(F.trim(F.regexp_replace(X.col(callsign), "[0-9]", "")))
    m = F.create_map(*[x for k, v in CALLSIGN_AIRLINE.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, letters), F.lit(""))


def scheduled_callsign(airline, number) -> Column:
    return F.upper(F.trim(F.concat(F.coalesce(X.col(airline).cast("string"), F.lit("")),
                                   F.coalesce(X.col(number).cast("string"), F.lit("")))))


# B19 ----------------------------------------------------------------------------------------------
def by_icao_prefix(df: DataFrame, airport_icao: str, country: str = "origin_country") -> DataFrame:
    """Keep aircraft registered in the country of the airport's code prefix (longest prefix wins); unknown -> all."""
    code = (airport_icao or "").strip().upper()
    hit = next((ICAO_PREFIX_COUNTRY[p] for p in sorted(ICAO_PREFIX_COUNTRY, key=len, reverse=True) if code.startswith(p)),
               None)
    return df.where(F.col(country) == hit) if hit else df


def age_label(age_seconds, fresh: int = 15, stale: int = 300) -> Column:
    """J2 in batch: fresh (<= 15 s), stale (<= 300 s), gone."""
    a = X.col(age_seconds)
    return F.when(a <= fresh, "fresh").when(a <= stale, "stale").otherwise("gone")
