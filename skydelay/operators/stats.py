"""Aggregations (survey §2.D).

All are hash aggregates with map-side partial aggregation, so a hot key (one airline holding a third of the rows)
is pre-combined per task before the shuffle. No aggregate collects a group into a list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skydelay.functions import exprs as X
from skydelay.operators.joins import RATE_KEYS


def mean(c, decimals: int | None = None) -> Column:
    """Average; with ``decimals`` the sum is exact (DECIMAL) so the result does not depend on summation order."""
    c = X.col(c)
    if decimals is None:
        return F.avg(c)
    return F.sum(c.cast(f"decimal(30,{decimals})")).cast("double") / F.count(c)


# D1 -----------------------------------------------------------------------------------------------
def global_rate(df: DataFrame, target: str = "IS_DELAYED") -> DataFrame:
    return df.agg(F.avg(target).alias("global_rate"))


# D2 -----------------------------------------------------------------------------------------------
GLOBAL_RATE = "GLOBAL_DELAY_RATE"


def rate_tables(df: DataFrame, target: str = "IS_DELAYED", include_global: bool = False) -> DataFrame:
    """Mean target by origin, destination, airline, route and airline x weekday in ONE pass (grouping sets).
    Long form: (rate, key, value, n). Null keys are excluded. ``include_global`` adds the overall mean (key null) from
    the same pass (an empty grouping set)."""
    keys = list(dict.fromkeys(RATE_KEYS.values()))
    sets = [[k] for k in keys] + ([[]] if include_global else [])
    g = df.groupingSets(sets, *keys).agg(
        F.avg(target).alias("value"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__gid"))
    n = len(keys)
    # each result row is named by its own grouping id: a union of filters would aggregate the whole table once per key
    ids = {rate: F.col("__gid") == sum(1 << (n - 1 - j) for j, k in enumerate(keys) if k != key) for rate, key in RATE_KEYS.items()}
    rate, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, key in RATE_KEYS.items():
        rate = F.when(ids[name] & F.col(key).isNotNull(), F.lit(name)).otherwise(rate)
        text = F.when(ids[name], F.col(key).cast("string")).otherwise(text)
    if include_global:
        rate = F.when(F.col("__gid") == (1 << n) - 1, F.lit(GLOBAL_RATE)).otherwise(rate)
    return g.select(rate.alias("rate"), text.alias("key"), "value", "n").where(F.col("rate").isNotNull())


# D3 -----------------------------------------------------------------------------------------------
def route_distance(df: DataFrame, route: str = "ROUTE", distance: str = "DISTANCE") -> DataFrame:
    """Mean distance by route plus the overall mean (route = null row) in one grouping-sets pass."""
    g = df.groupingSets([[route], []], route).agg(F.avg(distance).alias("mean_distance"), F.grouping_id().alias("__gid"))
    return g.where((F.col("__gid") == 1) | F.col(route).isNotNull()).select(
        F.when(F.col("__gid") == 0, F.col(route)).alias(route), "mean_distance", (F.col("__gid") == 1).alias("is_overall"))


# D4 -----------------------------------------------------------------------------------------------
CAUSE_COLUMNS = {  # fixed values: published cause name -> accepted raw column names (first present wins)
    "weather_delay": ["WEATHER_DELAY"],
    "late_aircraft_delay": ["LATE_AIRCRAFT_DELAY"],
    "nas_delay": ["NAS_DELAY", "AIR_SYSTEM_DELAY"],
    "security_delay": ["SECURITY_DELAY"],
    "carrier_delay": ["CARRIER_DELAY", "AIRLINE_DELAY"],
}


def origin_stats(df: DataFrame, key: str = "ORIGIN_AIRPORT") -> DataFrame:
    """Per origin: flights (non-null route count), delay rate, mean delay, mean of each delay-cause column present."""
    aggs = [F.count("ROUTE").alias("origin_flights"), F.avg("IS_DELAYED").alias("origin_delay_rate"),
            F.avg("ARRIVAL_DELAY").alias("origin_avg_arrival_delay")]
    for name, raws in CAUSE_COLUMNS.items():
        hit = next((r for r in raws if r in df.columns), None)
        if hit:
            aggs.append(F.avg(hit).alias(f"origin_avg_{name}"))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


# D5 -----------------------------------------------------------------------------------------------
def destination_stats(df: DataFrame, key: str = "DESTINATION_AIRPORT") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("ROUTE").alias("dest_flights"), F.avg("IS_DELAYED").alias("dest_delay_rate"),
        F.avg("ARRIVAL_DELAY").alias("dest_avg_arrival_delay"))


# D6 -----------------------------------------------------------------------------------------------
def dashboard_kpis(df: DataFrame) -> DataFrame:
    """Count, delay share (is_delayed = 1 -> 1 else 0: null counts as on time) and mean delay."""
    return df.agg(F.count(F.lit(1)).alias("total_flights"),
                  F.avg(F.when(F.col("is_delayed") == 1, 1.0).otherwise(0.0)).alias("delay_rate"),
                  F.avg("arrival_delay").alias("avg_delay"))


def _airline_label() -> Column:
    return F.coalesce(F.col("airline_name"), F.col("airline"))


# D7 -----------------------------------------------------------------------------------------------
def worst_airline(df: DataFrame) -> DataFrame:
    """The airline with the highest mean delay (ties: smallest name). One row, or none for no data."""
    per = df.groupBy(_airline_label().alias("airline")).agg(F.avg("arrival_delay").alias("avg_delay"))
    return per.where(F.col("avg_delay").isNotNull()).agg(
        F.min_by(F.struct("airline", "avg_delay"), F.struct(-F.col("avg_delay"), F.col("airline"))).alias("w")
    ).where(F.col("w").isNotNull()).select("w.airline", "w.avg_delay")


# D8 -----------------------------------------------------------------------------------------------
def delay_by_month(df: DataFrame) -> DataFrame:
    return df.groupBy("month").agg(F.avg("arrival_delay").alias("avg_delay")).orderBy("month")


# D9 -----------------------------------------------------------------------------------------------
def filter_options(df: DataFrame) -> DataFrame:
    """Distinct non-null years, months, airlines (coalesce(name, code)) and states as (dim, value) rows, sorted.
    One expand + one aggregate instead of four scans."""
    dims = F.array(
        F.struct(F.lit("year").alias("dim"), F.col("year").cast("string").alias("value")),
        F.struct(F.lit("month").alias("dim"), F.col("month").cast("string").alias("value")),
        F.struct(F.lit("airline").alias("dim"), F.when(F.col("airline").isNotNull(), _airline_label()).alias("value")),
        F.struct(F.lit("state").alias("dim"), F.col("origin_state").alias("value")),
    )
    long = df.select(F.inline(dims)).where(F.col("value").isNotNull()).distinct()
    num = F.col("value").try_cast("long")
    return long.orderBy("dim", F.when(F.col("dim").isin("year", "month"), num), "value")


# D10 ----------------------------------------------------------------------------------------------
def airports_per_country(airports: DataFrame) -> DataFrame:
    """Airports per country, sorted by country; ``n_countries`` repeats the number of countries on every row."""
    per = airports.where(F.col("country").isNotNull()).groupBy("country").agg(F.count(F.lit(1)).alias("airports"))
    return per.withColumn("n_countries", F.count(F.lit(1)).over(Window.partitionBy())).orderBy("country")


# D11 ----------------------------------------------------------------------------------------------
def classification_report(df: DataFrame, actual: str = "actual_is_delayed", predicted: str = "delay_prediction",
                          prob: str = "delay_probability") -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 (0 when undefined), Brier, actual and predicted rate,
    rounded to 4 places. A zero-row input gives one row with total_matched = 0."""
    y, p = F.col(actual).cast("int"), F.col(predicted).cast("int")
    c = df.agg(
        F.count(F.lit(1)).alias("total_matched"),
        F.count_if((p == 1) & (y == 1)).alias("true_positives"), F.count_if((p == 0) & (y == 0)).alias("true_negatives"),
        F.count_if((p == 1) & (y == 0)).alias("false_positives"), F.count_if((p == 0) & (y == 1)).alias("false_negatives"),
        F.avg((F.col(prob).cast("double") - y) ** 2).alias("__brier"), F.avg(y).alias("__ay"), F.avg(p).alias("__ap"))
    tp, tn, fp, fn, n = (F.col(x).cast("double") for x in
                         ("true_positives", "true_negatives", "false_positives", "false_negatives", "total_matched"))
    acc = F.when(n > 0, (tp + tn) / n).otherwise(0.0)
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    c = c.withColumns({"__prec": prec, "__rec": rec})
    f1 = F.when(F.col("__prec") + F.col("__rec") > 0,
                2 * F.col("__prec") * F.col("__rec") / (F.col("__prec") + F.col("__rec"))).otherwise(0.0)
    return c.select(
        "total_matched", F.bround(acc, 4).alias("accuracy"), F.bround("__prec", 4).alias("precision"),
        F.bround("__rec", 4).alias("recall"), F.bround(f1, 4).alias("f1_score"), F.bround("__brier", 4).alias("brier_score"),
        "true_positives", "true_negatives", "false_positives", "false_negatives",
        F.bround("__ay", 4).alias("actual_delay_rate"), F.bround("__ap", 4).alias("pred_delay_rate"))


# D12 ----------------------------------------------------------------------------------------------
def roc_auc(df: DataFrame, label: str = "actual_is_delayed", score: str = "delay_probability",
            buckets: int = 256) -> DataFrame:
    """Rank-based ROC AUC with tied scores averaged; null when only one class is present.

    AUC = sum over positives of (#negatives scored lower + half the negatives tied) / (P * N). Computed from a per-score
    histogram; the running count of negatives is a two-level prefix sum (score ranges with about as many distinct scores
    each, then within a range), so no window runs over all rows in one task, however the scores cluster. All sums are
    integers; one final division."""
    y = F.col(label).cast("int")
    hist = df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    # one row per distinct score, read four times below: materialize it once
    from skydelay.session import cut_lineage
    hist = cut_lineage(hist)
    shares = [i / buckets for i in range(1, buckets)]
    bounds = hist.agg(F.percentile_approx("s", F.array(*map(F.lit, shares)), 20 * buckets).alias("v")).first()["v"] or []
    edges = F.array(*[F.lit(float(x)) for x in sorted(set(bounds))]).cast("array<double>")
    hist = hist.withColumn("b", F.size(F.filter(edges, lambda x: x < F.col("s"))))  # bounds below the score
    per_bucket = hist.groupBy("b").agg(F.sum("neg").alias("bneg"))
    wb = Window.partitionBy().orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # <= ``buckets`` rows
    per_bucket = per_bucket.withColumn("neg_before_bucket", F.coalesce(F.sum("bneg").over(wb), F.lit(0)))
    ws = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    h = hist.join(per_bucket.select("b", "neg_before_bucket"), "b") \
        .withColumn("neg_below", F.col("neg_before_bucket") + F.coalesce(F.sum("neg").over(ws), F.lit(0)))
    tot = h.agg(F.sum("pos").cast("decimal(38,0)").alias("P"), F.sum("neg").cast("decimal(38,0)").alias("N"),
                F.sum(F.col("pos").cast("decimal(38,0)") * (2 * F.col("neg_below") + F.col("neg"))).alias("twice"))
    return tot.select(F.when((F.col("P") > 0) & (F.col("N") > 0),
                             F.col("twice").cast("double") / (2 * F.col("P").cast("double") * F.col("N").cast("double")))
                      .alias("roc_auc"), F.col("P").cast("long").alias("positives"), F.col("N").cast("long").alias("negatives"))


# D13 ----------------------------------------------------------------------------------------------
def class_balance(df: DataFrame, target: str = "IS_DELAYED") -> DataFrame:
    """Per class: count, balanced weight n / (2 * n_class); plus neg/pos ratio with each count floored at 1."""
    per = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy()  # over the classes only (2 rows)
    total = F.sum("count").over(w)
    pos = F.greatest(F.sum(F.when(F.col("class") == 1, F.col("count")).otherwise(0)).over(w), F.lit(1))
    neg = F.greatest(F.sum(F.when(F.col("class") == 0, F.col("count")).otherwise(0)).over(w), F.lit(1))
    return per.select("class", "count", (total / (2.0 * F.col("count"))).alias("balanced_weight"),
                      (neg.cast("double") / pos).alias("neg_pos_ratio"))


# D14 ----------------------------------------------------------------------------------------------
def route_risk(df: DataFrame, prob: str = "delay_probability", origin="ORIGIN_AIRPORT", dest="DESTINATION_AIRPORT",
               decimals: int | None = None) -> DataFrame:
    """Per route over a scored schedule: mean probability, flights, risk level."""
    return df.groupBy(origin, dest).agg(mean(prob, decimals).alias("mean_probability"),
                                        F.count(F.lit(1)).alias("flights")) \
        .withColumn("risk_level", X.risk_level("mean_probability"))


# D15 ----------------------------------------------------------------------------------------------
def best_options(df: DataFrame, prob: str = "delay_probability", origin="ORIGIN_AIRPORT", dest="DESTINATION_AIRPORT",
                 date_col: str = "_flight_date", airline: str = "AIRLINE", dep: str = "SCHEDULED_DEPARTURE",
                 decimals: int | None = None) -> DataFrame:
    """Per route: the day with the lowest mean probability, the airline with the lowest mean probability and the
    departure (HH:MM) of the single lowest-probability flight. Ties: earliest day, smallest airline, then the
    earliest departure key. Everything is partial aggregation (min_by), no window over a route."""
    r = [origin, dest]
    by_day = df.where(F.col(date_col).isNotNull()).groupBy(*r, date_col).agg(mean(prob, decimals).alias("__m")) \
        .groupBy(*r).agg(F.min_by(F.col(date_col), F.struct(F.col("__m"), F.col(date_col))).alias("lowest_risk_day"))
    code = X.code_text(airline)
    by_air = df.where(F.col(airline).isNotNull()).groupBy(*r, code.alias("__a")).agg(mean(prob, decimals).alias("__m")) \
        .groupBy(*r).agg(F.min_by(F.col("__a"), F.struct(F.col("__m"), F.col("__a"))).alias("lowest_risk_airline"))
    by_dep = df.where(F.col(dep).isNotNull() & F.col(prob).isNotNull()).groupBy(*r).agg(
        F.min_by(X.format_hhmm(dep), F.struct(F.col(prob), X.departure_sort_key(dep))).alias("lower_risk_departure"))
    keys = df.select(*r).distinct()
    return _left_ns(_left_ns(_left_ns(keys, by_day, r), by_air, r), by_dep, r)


def _left_ns(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on null-safe key equality (a route with a missing side is still a group)."""
    rr = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    out = left.join(rr, [left[k].eqNullSafe(rr[f"__r_{k}"]) for k in keys], "left")
    return out.drop(*[f"__r_{k}" for k in keys])


# D16 ----------------------------------------------------------------------------------------------
def day_average_risk(df: DataFrame, keys: Sequence[str], prob: str = "delay_probability",
                     decimals: int | None = None) -> DataFrame:
    """Mean probability over the 24 hour slots (C7) of each request/route key."""
    return df.groupBy(*keys).agg(mean(prob, decimals).alias("day_average_probability"),
                                 F.count(F.lit(1)).alias("slots"))


# D17 ----------------------------------------------------------------------------------------------
def destination_countries(dep: DataFrame, airports: DataFrame, origin: str = "ORIGIN_AIRPORT",
                          dest: str = "DESTINATION_AIRPORT") -> DataFrame:
    """Sorted distinct destination countries per origin (distinct pairs first: the set per origin is bounded by the
    number of countries, never by the number of flights)."""
    dim = airports.select(F.col("iata_code").alias("__c"), F.col("country").alias("__country"))
    pairs = dep.select(X.code_text(origin).alias(origin), X.code_text(dest).alias("__d")).distinct()
    j = pairs.join(dim, pairs["__d"] == dim["__c"], "inner").select(origin, "__country").distinct()
    return j.groupBy(origin).agg(F.array_join(F.array_sort(F.collect_list("__country")), "|").alias("countries"),
                                 F.count(F.lit(1)).alias("n_countries"))


# D18 ----------------------------------------------------------------------------------------------
def partition_list(df: DataFrame, year: str = "year", month: str = "month") -> DataFrame:
    return df.where(F.col(year).isNotNull() & F.col(month).isNotNull()).select(year, month).distinct()


# D19 ----------------------------------------------------------------------------------------------
def partition_counts(df: DataFrame, cols: Sequence[str] = ("year", "month")) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond).groupBy(*cols).agg(F.count(F.lit(1)).alias("rows"))


# D20 ----------------------------------------------------------------------------------------------
def exact_median(df: DataFrame, c: str, accuracy: int = 1_000_000) -> Column:
    """Exact median (mean of the two middle values for an even count) as a scalar Column, without holding every
    distinct value in one task.

    ``percentile_approx`` ranks are within n / accuracy of the requested rank, so the values it returns for
    0.5 -/+ 2 / accuracy bracket the true median. The rows inside that bracket are counted by value, so ties are one row,
    and the counts are summed up over the distinct values, of which the bracket holds at most about 4 n / accuracy; the
    rank offset is the exact count of rows below the bracket."""
    x = df.select(F.col(c).cast("double").alias("__x")).where(F.col("__x").isNotNull())
    e = 2.0 / accuracy
    st = x.agg(F.count(F.lit(1)).alias("n"),
               F.percentile_approx("__x", F.array(F.lit(max(0.0, 0.5 - e)), F.lit(min(1.0, 0.5 + e))), accuracy).alias("b"))
    n = st.select("n").scalar()
    lo = st.select(F.col("b")[0]).scalar()
    hi = st.select(F.col("b")[1]).scalar()
    below = x.where(F.col("__x") < lo).agg(F.count(F.lit(1))).scalar()
    k1 = F.floor((n + 1) / 2)   # lower middle rank (1-based)
    k2 = F.floor(n / 2) + 1     # upper middle rank
    values = x.where((F.col("__x") >= lo) & (F.col("__x") <= hi)).groupBy("__x").agg(F.count(F.lit(1)).alias("__n"))
    last = below + F.sum("__n").over(Window.orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = values.withColumn("__last", last).withColumn("__first", F.col("__last") - F.col("__n") + 1)
    holds = lambda k: F.col("__first").__le__(k) & F.col("__last").__ge__(k)
    low, high = F.max(F.when(holds(k1), F.col("__x"))), F.max(F.when(holds(k2), F.col("__x")))
    return ranked.agg(((low + high) / 2).alias("m")).scalar()


def impute_values(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """(feature, kind, num_value, cat_value): exact median per numeric column (see ``exact_median``), most frequent
    value per categorical column (smallest on ties: a count per (feature, value), then min_by)."""
    out = None
    spark = df.sparkSession
    if numeric:
        from skydelay.session import cut_lineage
        nums = cut_lineage(df.select(*numeric))  # each median reads its column several times: compute the input once
        rows = [spark.range(1).select(F.lit(c).alias("feature"), F.lit("numeric").alias("kind"),
                                      exact_median(nums, c).cast("double").alias("num_value"),
                                      F.lit(None).cast("string").alias("cat_value")) for c in numeric]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
    if categorical:
        pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                                             for c in categorical]))).where(F.col("value").isNotNull())
        counts = pairs.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        top = counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value")) \
            .select("feature", F.lit("categorical").alias("kind"), F.lit(None).cast("double").alias("num_value"),
                    F.col("value").alias("cat_value"))
        out = top if out is None else out.unionByName(top)
    return out
