"""Batch jobs composed from the operators (survey I15, H31 and the weekly jobs' table logic).

One lazy plan from the raw tables to every output; Catalyst prunes columns and pushes filters through the joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skydelay.functions import exprs as X
from skydelay.functions.calendar import with_is_holiday
from skydelay.operators import joins as J
from skydelay.operators import ranking as R
from skydelay.operators import rows as B
from skydelay.operators import stats as D
from skydelay.session import cut_lineage

LEGACY_ALIASES = {"PERIODO_DIA": "TIME_OF_DAY", "ESTACAO": "SEASON", "IS_FERIADO": "IS_HOLIDAY", "ROTA": "ROUTE"}
SPLIT_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# H31 ----------------------------------------------------------------------------------------------
def engineer_features(df: DataFrame, legacy: bool = False, with_target: bool = True) -> DataFrame:
    """H1-H7 in one projection (+ the holiday join): TIME_OF_DAY, SEASON, IS_HOLIDAY, ROUTE, AIRLINE_DOW, IS_DELAYED;
    ``legacy`` adds the old alias columns."""
    hour = X.dep_hour("SCHEDULED_DEPARTURE")
    out = df.withColumns({
        "TIME_OF_DAY": X.time_of_day(hour),
        "SEASON": X.season(F.col("MONTH").cast("int")),
        "ROUTE": X.route_key("ORIGIN_AIRPORT", "DESTINATION_AIRPORT"),
        "AIRLINE_DOW": X.airline_dow("AIRLINE", "DAY_OF_WEEK"),
        "__date": X.flight_date(df.columns),
    })
    if with_target and "ARRIVAL_DELAY" in df.columns:
        out = out.withColumn("IS_DELAYED", X.is_delayed("ARRIVAL_DELAY"))
    out = with_is_holiday(out, "__date").drop("__date")
    if legacy:
        out = out.withColumns({k: F.col(v) for k, v in LEGACY_ALIASES.items()})
    return out


def enrich(flights: DataFrame, airports: DataFrame, airlines: DataFrame) -> DataFrame:
    """C1 + C2 + B1 + H31: the cleaned, joined, featured flights (before target encoding)."""
    joined = J.join_airports(J.join_airline(flights, airlines), airports)
    return engineer_features(B.clean_flights(joined))


@dataclass
class Preprocessed:
    flights_processed: DataFrame
    train: DataFrame
    test: DataFrame
    airport_profiles: DataFrame
    rates: DataFrame
    global_rate: DataFrame


# I15 ----------------------------------------------------------------------------------------------
def preprocess(flights: DataFrame, airports: DataFrame, airlines: DataFrame, test_size: float = 0.2, seed: int = 42,
               split_keys=SPLIT_KEYS) -> Preprocessed:
    """The batch job: join, clean, features, stratified split, target encodings from train only, airport profiles."""
    # the cleaned rows feed the split levels, the rates, the profiles and three outputs: compute them once
    data = cut_lineage(enrich(flights, airports, airlines))
    split = R.stratified_split(data, "IS_DELAYED", test_size, seed, list(split_keys), materialize=False)
    train = split.where("is_train").drop("is_train")
    test = split.where(~F.col("is_train")).drop("is_train")
    # rate tables have one row per key value (bounded by the dimensions, not the flights) and are read by five
    # lookups in three outputs: materialize them once
    all_rates = cut_lineage(D.rate_tables(train, include_global=True))
    rates = all_rates.where(F.col("rate") != D.GLOBAL_RATE)
    g = all_rates.where(F.col("rate") == D.GLOBAL_RATE).select(F.col("value").alias("global_rate"))
    gr = g.first()["global_rate"]  # the one global row
    return Preprocessed(
        flights_processed=J.apply_rates(data, rates, gr),
        train=J.apply_rates(train, rates, gr),
        test=J.apply_rates(test, rates, gr),
        airport_profiles=J.airport_profiles(data, airports),
        rates=rates,
        global_rate=g,
    )
