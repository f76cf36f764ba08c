"""K1: the scalar expressions as SQL functions (``CREATE TEMPORARY FUNCTION ... RETURN expr``).

SQL UDFs with a SQL body are inlined by Catalyst, so they run as built-in expressions (codegen, pushdown); no
Python is involved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from skydelay.functions import exprs as X

# name -> (parameters, the expression that the column form uses too)
FUNCTIONS: dict[str, tuple[str, Callable[..., Column]]] = {
    "dep_hour": ("hhmm INT", X.dep_hour),
    "time_of_day": ("hour INT", X.time_of_day),
    "season": ("m INT", X.season),
    "route_key": ("o STRING, d STRING", X.route_key),
    "airline_dow": ("a STRING, w INT", X.airline_dow),
    "is_delayed": ("delay DOUBLE", X.is_delayed),
    "clamp_hhmm": ("v DOUBLE", X.clamp_hhmm),
    "format_hhmm": ("v STRING", X.format_hhmm),
    "departure_sort_key": ("v STRING", X.departure_sort_key),
    "risk_level": ("p DOUBLE", X.risk_level),
    "delay_prediction": ("p DOUBLE, t DOUBLE", lambda p, t: F.when(p.isNotNull(), (p >= F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))).cast("int"))),
    "speed_kmh": ("ms DECIMAL(20,6)", lambda ms: F.expr("CAST(ROUND(ms * 3.6, 1) AS DOUBLE)")),
    "altitude_ft": ("m DECIMAL(20,6)", lambda m: F.expr("CAST(ROUND(m * 3.28084, 0) AS DOUBLE)")),
}


def sql_body(spark: SparkSession, params: str, build: Callable[..., Column]) -> str:
    """The SQL text of an expression over parameters: what Spark prints for the resolved expression."""
    names = [p.split() for p in params.replace("(20,6)", "(20;6)").split(", ")]
    frame = spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {kind.replace(';', ',')}) AS {name}" for name, kind in names))
    resolved = frame.select(build(*[F.col(name) for name, _ in names]).alias("r"))._jdf.queryExecution().analyzed()
    return resolved.expressions().apply(0).child().sql()


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create (or replace) every function as a temporary SQL function; returns the names."""
    for name, (params, build) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({params}) RETURN {sql_body(spark, params, build)}")
    return [f"{prefix}{name}" for name in FUNCTIONS]
