"""Windows, ranking, de-duplication, top-k and ordered unions (survey §2.E, §2.F, §2.G).

Scale rules used here:
* "first row per key" is ``min_by(struct)`` - an aggregate with map-side partial combine, so a hot key never lands
  whole in one task;
* "first n per key" is ``row_number() <= n``: Spark inserts a partial WindowGroupLimit before the shuffle, so at most
  n rows per key and map task are shuffled;
* global top-n is ``orderBy().limit(n)`` (TakeOrderedAndProject: a bounded heap per task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skydelay.functions import exprs as X
from skydelay.operators.cut import kth_smallest_per_group
from skydelay.operators.joins import RATE_KEYS
from skydelay.operators.rows import hash_key
from skydelay.session import cut_lineage


# E1 -----------------------------------------------------------------------------------------------
def stratified_split(df: DataFrame, target: str, test_size: float, seed: int, keys: Sequence[str],
                     materialize: bool = True) -> DataFrame:
    """Adds ``is_train``: per class, rows ordered by md5(seed|key...); the first floor(n * (1 - test_size)) go to train.
    The cut per class comes from the distributed histogram refinement (operators.cut), then one comparison."""
    h = df.withColumn("__h", hash_key(seed, keys))
    cut = kth_smallest_per_group(h, "__h", [target], lambda n: F.floor(n * F.lit(1.0 - test_size)),
                                 materialize=materialize)
    # one row per class: checkpointed so consumers of the split do not re-plan the refinement
    cut = cut_lineage(cut.select(F.col(target).alias("__t"), "__cut"))
    out = h.join(F.broadcast(cut), h[target].eqNullSafe(cut["__t"]), "left")
    return out.withColumn("is_train", F.col("__h") <= F.coalesce(F.col("__cut"), F.lit(""))).drop("__t", "__cut", "__h")


# E2 -----------------------------------------------------------------------------------------------
def top_factors(df: DataFrame, global_rate, k: int = 3, rates: Sequence[str] = tuple(RATE_KEYS)) -> DataFrame:
    """Per row: the k rate columns farthest from the global rate, as an array of (feature, impact) with impact text
    '+x.x%'. Sorted by |rate - global| desc (stable: column order breaks ties). No shuffle."""
    g = global_rate if isinstance(global_rate, Column) else F.lit(float(global_rate))
    items = F.array(*[F.struct((F.abs(F.col(r) - g)).alias("d"), F.lit(i).alias("i"), F.lit(r.lower()).alias("feature"),
                               F.format_string("%+.1f%%", (F.col(r) - g) * 100).alias("impact"))
                      for i, r in enumerate(rates)])
    ordered = F.array_sort(items, lambda a, b: F.when(a["d"] > b["d"], -1).when(a["d"] < b["d"], 1)
                           .otherwise(a["i"] - b["i"]))
    return df.withColumn("top_factors", F.transform(F.slice(ordered, 1, k),
                                                    lambda s: F.struct(s["feature"].alias("feature"), s["impact"].alias("impact"))))


# E3 -----------------------------------------------------------------------------------------------
def merged_factors(first: Column, more: Column, k: int = 3) -> Column:
    """The first factors, then those of ``more`` whose feature is not among them, cut to k."""
    fresh = F.filter(more, lambda f: ~F.array_contains(F.transform(first, lambda x: x["feature"]), f["feature"]))
    return F.slice(F.concat(first, fresh), 1, k)


def advisor_factors(df: DataFrame, context_col: str = "context_factors", model_col: str = "top_factors",
                    extra_col: str | None = None, k: int = 3, out: str = "advisor_factors") -> DataFrame:
    """Context factors first, then model factors whose feature is not already present, cut to k; optional extra
    (weekly) factors appended the same way and cut to k again."""
    res = merged_factors(F.col(context_col), F.col(model_col), k)
    if extra_col:
        res = merged_factors(res, F.col(extra_col), k)
    return df.withColumn(out, res)


# E4 -----------------------------------------------------------------------------------------------
def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], descending: Sequence[bool] = ()) -> DataFrame:
    """First row per key in a stated order (ascending, nulls last; ``descending[i]`` flips a numeric order column),
    as one partial aggregate: min_by(row, (order..., row)). The row itself is the last tie-breaker, so the pick is
    deterministic even with equal order values."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.select(*keys).distinct()
    row = F.struct(*[F.col(c) for c in others])
    ords: list[Column] = []
    for i, o in enumerate(order):
        desc = i < len(descending) and descending[i]
        ords += [o.isNull().alias(f"__n{i}"), (-o if desc else o).alias(f"__o{i}")]
    agg = df.groupBy(*keys).agg(F.min_by(row, F.struct(*ords, row.alias("__row"))).alias("__r"))
    return agg.select(*keys, *[F.col("__r")[c].alias(c) for c in others])


# E5 -----------------------------------------------------------------------------------------------
def last_messages(df: DataFrame, n: int, drop_roles: Sequence[str] = (), session: str = "session_id",
                  turn: str = "turn", role: str = "role") -> DataFrame:
    """Last n turns per session (optionally without some roles), in turn order."""
    kept = df.where(~F.col(role).isin(list(drop_roles))) if drop_roles else df
    w = Window.partitionBy(session).orderBy(F.col(turn).desc())
    return kept.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


# E6 -----------------------------------------------------------------------------------------------
def carry_route_forward(df: DataFrame, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """Per message: the latest non-empty origin (airport + country travel together) and, independently, destination,
    up to and including this message (its own value wins).

    A segmented scan: rows sorted by range of (session, turn) lie in pieces, a long session in many tasks; each piece is
    scanned by itself, and the last value of the pieces before it (one row per piece and session) fills what it leaves open."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = cut_lineage(df.repartitionByRange(width, session, turn).sortWithinPartitions(session, turn)
                        .withColumn("__at", F.monotonically_increasing_id())).withColumn("__piece", F.shiftright("__at", 33))
    values = {}
    for side in ("origin", "destination"):
        a, c = F.col(f"{side}_airport"), F.col(f"{side}_country")
        has = X.blank_to_null(a).isNotNull() | X.blank_to_null(c).isNotNull()
        values[side] = F.when(has, F.struct(a.alias("airport"), c.alias("country")))
    ends = table.groupBy(F.col(session).alias("__s"), F.col("__piece").alias("__p")).agg(
        *[F.max_by(v, F.when(v.isNotNull(), F.col("__at"))).alias(f"__end_{side}") for side, v in values.items()])
    before = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a task
    carries = ends.select("__s", "__p", *[F.last(f"__end_{side}", ignorenulls=True).over(before).alias(f"__carry_{side}") for side in values])
    here = Window.partitionBy(session, "__piece").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = table.withColumns({f"__{side}": F.last(v, ignorenulls=True).over(here) for side, v in values.items()}) \
        .join(carries, F.col(session).eqNullSafe(F.col("__s")) & (F.col("__piece") == F.col("__p")))
    carried = {f"carried_{side}_{part}": F.coalesce(f"__{side}", f"__carry_{side}")[part] for side in values for part in ("airport", "country")}
    return out.withColumns(carried).select(*df.columns, *carried)


# E7 -----------------------------------------------------------------------------------------------
def latest_route_update(df: DataFrame, session: str = "session_id", turn: str = "turn",
                        fields: Sequence[str] = ("origin_airport", "origin_country", "destination_airport",
                                                 "destination_country")) -> DataFrame:
    """Per session, the latest message that sets either side, returned whole (max_by: partial aggregation)."""
    has = F.lit(False)
    for f in fields:
        has = has | X.blank_to_null(f).isNotNull()
    others = [c for c in df.columns if c != session]
    agg = df.where(has).groupBy(session).agg(F.max_by(F.struct(*others), F.col(turn)).alias("__r"))
    return agg.select(session, *[F.col("__r")[c].alias(c) for c in others])


# E12 ----------------------------------------------------------------------------------------------
def top_attributions(df: DataFrame, row_id, features: Sequence[str], value_prefix: str = "",
                     attr_prefix: str = "attr_", k: int = 5) -> DataFrame:
    """Per row the k largest |attribution| in long form: row id column(s), rank, feature, value, attribution, abs."""
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    items = F.array(*[F.struct(F.abs(F.col(attr_prefix + f)).alias("abs"), F.lit(i).alias("i"), F.lit(f).alias("feature"),
                               F.col(value_prefix + f).cast("string").alias("value"), F.col(attr_prefix + f).alias("attribution"))
                      for i, f in enumerate(features)])
    ordered = F.array_sort(items, lambda a, b: F.when(a["abs"] > b["abs"], -1).when(a["abs"] < b["abs"], 1)
                           .otherwise(a["i"] - b["i"]))
    return df.select(*ids, F.posexplode(F.slice(ordered, 1, k)).alias("pos", "t")).select(
        *ids, (F.col("pos") + 1).alias("rank"), "t.feature", "t.value", "t.attribution", "t.abs")


# F1 -----------------------------------------------------------------------------------------------
def delay_by_airline(df: DataFrame, n: int = 20) -> DataFrame:
    """Mean delay per airline label, top n by mean delay desc (ties by airline)."""
    per = df.groupBy(F.coalesce(F.col("airline_name"), F.col("airline")).alias("airline")).agg(
        F.avg("arrival_delay").alias("avg_delay"))
    return per.orderBy(F.col("avg_delay").desc_nulls_last(), "airline").limit(n)


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    """The caller's limit; None returns all rows (ranges of request parameters are B14's to check)."""
    return df if limit is None else df.limit(int(limit))


def _formatted(df: DataFrame, airport: str | None = None) -> list[Column]:
    origin = F.upper(X.blank_to_null("ORIGIN_AIRPORT")) if airport is None else F.lit(airport)
    dest = F.upper(X.blank_to_null("DESTINATION_AIRPORT"))
    airline = F.upper(X.blank_to_null("AIRLINE"))
    fn = X.flight_number_text("FLIGHT_NUMBER") if "FLIGHT_NUMBER" in df.columns else F.lit(None).cast("string")
    return [F.date_format("_flight_date", "yyyy-MM-dd").alias("flight_date"), fn.alias("flight_number"),
            airline.alias("airline"), origin.alias("origin_airport"), dest.alias("destination_airport")]


# F2 -----------------------------------------------------------------------------------------------
def upcoming_flights(df: DataFrame, as_of: str, limit: int | None = 50) -> DataFrame:
    """B8 window ordered by date, the first ``limit`` (None: all), formatted records plus the count matched."""
    from skydelay.operators.rows import upcoming_window
    w = upcoming_window(df, as_of)
    matched = w.agg(F.count(F.lit(1))).scalar()
    rows = _first(w.orderBy(*_schedule_order(w)), limit)
    base = _formatted(rows)
    origin, dest = F.col("origin_airport"), F.col("destination_airport")
    return rows.select(*base, X.format_hhmm("SCHEDULED_DEPARTURE").alias("scheduled_departure"),
                       F.col("DISTANCE").cast("double").alias("distance_miles"), "used_future") \
        .withColumn("route", F.when(origin.isNotNull() & dest.isNotNull(), F.concat(origin, F.lit(" -> "), dest))) \
        .withColumn("matched", matched)


def _schedule_order(df: DataFrame) -> list[Column]:
    """Date, departure key, then the flight's identity: rows still tied have identical formatted output."""
    tail = [c for c in ("AIRLINE", "FLIGHT_NUMBER", "ORIGIN_AIRPORT", "DESTINATION_AIRPORT", "DISTANCE") if c in df.columns]
    return [F.col("_flight_date").asc_nulls_last(), X.departure_sort_key("SCHEDULED_DEPARTURE").asc(),
            *[F.col(c).asc_nulls_last() for c in tail]]


# F3 -----------------------------------------------------------------------------------------------
def airport_departures(df: DataFrame, airport: str, as_of: str, limit: int | None = 50) -> DataFrame:
    """Departures of one airport (trim/upper match), B8 window, order by date then departure key, formatted."""
    from skydelay.operators.rows import upcoming_window
    code = airport.strip().upper()
    f = df.where(X.code_text("ORIGIN_AIRPORT") == code)
    w = upcoming_window(f, as_of).withColumn("__dep", X.departure_sort_key("SCHEDULED_DEPARTURE"))
    matched = w.agg(F.count(F.lit(1))).scalar()
    rows = _first(w.orderBy(*_schedule_order(w.drop("ORIGIN_AIRPORT"))), limit)
    fn = X.flight_number_text("FLIGHT_NUMBER")
    airline = F.upper(X.blank_to_null("AIRLINE"))
    return rows.select(F.date_format("_flight_date", "yyyy-MM-dd").alias("flight_date"),
                       F.date_format("_flight_date", "dd/MM/yyyy").alias("flight_date_br"),
                       airline.alias("airline"), fn.alias("flight_number"), X.flight_code(airline, fn).alias("flight_code"),
                       F.lit(code).alias("origin_airport"), F.upper(X.blank_to_null("DESTINATION_AIRPORT")).alias("destination_airport"),
                       X.format_hhmm("SCHEDULED_DEPARTURE").alias("scheduled_departure"), "used_future") \
        .withColumn("matched", matched)


# F4 -----------------------------------------------------------------------------------------------
def airports_of_country(airports: DataFrame, country: str, limit: int | None = None) -> DataFrame:
    """Airports of one country (case-folded), ordered by city, name, code with nulls last."""
    target = country.strip().lower()
    f = airports.where(F.lower(F.trim(F.col("country"))) == target)
    return _first(f.orderBy(*[F.col(c).asc_nulls_last() for c in ("city", "airport_name", "iata_code")]), limit)


# F5 / F6 ------------------------------------------------------------------------------------------
def _dedupe_key() -> list[Column]:
    return [F.date_format("_flight_date", "yyyy-MM-dd"), F.upper(X.blank_to_null("AIRLINE")),
            X.flight_number_text("FLIGHT_NUMBER"), X.format_hhmm("SCHEDULED_DEPARTURE")]


def rank_schedule(scored: DataFrame, n: int = 3, keys: Sequence[str] = ("ORIGIN_AIRPORT", "DESTINATION_AIRPORT"),
                  prob: str = "delay_probability") -> DataFrame:
    """Per route: de-duplicate on (date, airline, number, departure) keeping the best-ranked row, then the n best
    by probability, date, departure key (nulls last)."""
    d = scored.withColumn("__dep", X.departure_sort_key("SCHEDULED_DEPARTURE")) \
        .withColumns({f"__k{i}": c for i, c in enumerate(_dedupe_key())})
    order = [F.col(prob).asc_nulls_last(), F.col("_flight_date").asc_nulls_last(), F.col("__dep").asc(),
             F.col("__k1").asc_nulls_last(), F.col("__k2").asc_nulls_last()]
    dk = [f"__k{i}" for i in range(4)]
    w1 = Window.partitionBy(*keys, *dk).orderBy(*order)
    first = d.withColumn("__r1", F.row_number().over(w1)).where("__r1 = 1")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    top = first.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= n)
    return top.drop("__r1", "__dep", *dk)


def suggest_flights(schedule: DataFrame, request: dict, n: int = 3, prob: str = "delay_probability") -> DataFrame:
    """Two attempts (route + date filters; route only), the requested flight excluded, ordered by probability,
    date, same airline first, departure; de-duplicated across attempts (the earlier attempt wins); n rows."""
    from skydelay.operators.rows import exclude_requested, filter_flights
    if "_flight_date" not in schedule.columns:
        schedule = schedule.withColumn("_flight_date", X.flight_date(schedule.columns))
    airline = (request.get("airline") or "").strip().upper() or None
    attempts = [
        filter_flights(schedule, origin=request.get("origin_airport"), dest=request.get("destination_airport"),
                       flight_date=request.get("flight_date"), year=request.get("year"), month=request.get("month"),
                       day=request.get("day"), dow=request.get("day_of_week")),
        filter_flights(schedule, origin=request.get("origin_airport"), dest=request.get("destination_airport")),
    ]
    parts = []
    for i, a in enumerate(attempts):
        a = exclude_requested(a, airline, request.get("scheduled_departure"))
        parts.append(a.withColumn("attempt", F.lit(i)))
    u = union_attempts(parts, _dedupe_key(), [
        F.col(prob).asc_nulls_last(), F.col("_flight_date").asc_nulls_last(),
        (X.code_text("AIRLINE") == F.lit(airline or "")).desc(), X.departure_sort_key("SCHEDULED_DEPARTURE").asc()])
    return u.orderBy(F.col("attempt"), F.col(prob).asc_nulls_last(), F.col("_flight_date").asc_nulls_last(),
                     (X.code_text("AIRLINE") == F.lit(airline or "")).desc(),
                     X.departure_sort_key("SCHEDULED_DEPARTURE").asc(), *[F.col(c) for c in ("AIRLINE", "FLIGHT_NUMBER")]).limit(n)


# G1 -----------------------------------------------------------------------------------------------
def union_attempts(parts: Sequence[DataFrame], dedupe: Sequence[Column], order: Sequence[Column],
                   attempt: str = "attempt") -> DataFrame:
    """Ordered union: rows equal on ``dedupe`` keep only the one from the earliest attempt (then best ``order``)."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.withColumns({f"__u{i}": c for i, c in enumerate(dedupe)})
    keys = [f"__u{i}" for i in range(len(dedupe))]
    w = Window.partitionBy(*keys).orderBy(F.col(attempt).asc(), *order)
    return u.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", *keys)


# F7 -----------------------------------------------------------------------------------------------
def search_callsigns(catalog: DataFrame, queries: DataFrame, n: int = 8, key: str = "callsign",
                     query_id: str = "query_id", query: str = "query") -> DataFrame:
    """Per query: callsigns starting with the query first, then those containing it (each group by callsign), n rows;
    a blank query lists the first n callsigns. Containment is an equality join on the rarest gram of each distinct query
    (``containment``); blank queries join the first n callsigns on an empty key. No nested-loop join."""
    from skydelay.operators.containment import contained
    q = queries.select(query_id, F.upper(F.trim(F.col(query))).alias("__q"))
    c = catalog.select(F.col(key).alias("__c")).where(F.col("__c").isNotNull() & (F.col("__c") != "")).distinct()
    hits = q.join(contained(q, c, "__q", "__c"), "__q").select(query_id, "__q", "__c")
    first = c.orderBy("__c").limit(n).withColumn("__q", F.lit(""))  # bounded: n rows
    blanks = q.where(F.col("__q") == "").join(first, "__q").select(query_id, "__q", "__c")
    j = hits.unionByName(blanks)
    prio = F.when(F.col("__q") == "", 0).when(F.col("__c").startswith(F.col("__q")), 0).otherwise(1)
    w = Window.partitionBy(query_id).orderBy(prio, "__c")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n) \
        .select(query_id, F.col("__c").alias(key), "rank")


# F9 -----------------------------------------------------------------------------------------------
def destinations_board(dep: DataFrame, airports: DataFrame, country: str | None = None, n: int = 30,
                       dest: str = "DESTINATION_AIRPORT") -> DataFrame:
    """Optional destination-country filter, the first departure per destination (by date then departure key), n rows
    ordered the same way, with the destination airport name."""
    from skydelay.operators.joins import lookup_airport
    d = lookup_airport(dep, airports, dest, "dest")
    if country:
        d = d.where(F.lower(F.col("dest_country")) == country.strip().lower())
    d = d.withColumn("__dep", X.departure_sort_key("SCHEDULED_DEPARTURE")).withColumn("__dest", X.code_text(dest))
    first = keep_first(d.where(F.col("__dest").isNotNull()), ["__dest"],
                       [F.col("_flight_date"), F.col("__dep")])
    return first.orderBy(F.col("_flight_date").asc_nulls_last(), "__dep", "__dest").limit(n) \
        .select(F.col("__dest").alias("destination_airport"),
                F.coalesce(F.col("dest_airport_name"), F.col("__dest")).alias("airport_name"),
                F.date_format("_flight_date", "yyyy-MM-dd").alias("flight_date"),
                X.format_hhmm("SCHEDULED_DEPARTURE").alias("scheduled_departure"), F.upper(F.col("AIRLINE")).alias("airline"))
