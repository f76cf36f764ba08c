"""Registered queries: Spark ML training, scoring, evaluation, persistence, explanations and the weekly jobs
(survey I1-I8, I10, I11). Fitted models are not SQL-expressible: these are rows-only checks (plus pytest invariants),
except the linear attribution, whose exact formula has a DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skydelay.plans import ml
from skydelay.plans import weekly as W
from skydelay.plans.fixtures import AS_OF_FUTURE
from skydelay.plans.queries import KEYS, V, pre, query
from skydelay.plans.queries_schedule import D11_SQL, D12_SQL, matched
from skydelay.plans.queries_live import scratch

_MODELS: dict = {}


def fitted(spark, sf, model_type: str = "rf"):
    """(model, features, preprocessed) trained once per session and scale factor."""
    key = (id(spark._jsparkSession), sf, model_type)
    if key not in _MODELS:
        p = pre(spark, sf)
        model, fs = ml.train(p.train, model_type)
        _MODELS[key] = (model, fs, p)
    return _MODELS[key]


def _eval(spark, sf, model_type):
    model, _, p = fitted(spark, sf, model_type)
    return ml.evaluate(ml.score(p.test, model)).withColumn("model_type", F.lit(model_type))


@query("I1_feature_pipeline")
def q_i1(spark, sf):
    from pyspark.ml import Pipeline
    p = pre(spark, sf)
    data, fs = ml.resolve_features(p.train)
    fitted_stages = Pipeline(stages=ml.feature_stages(fs)).fit(data)
    out = fitted_stages.transform(ml.resolve_features(p.test)[0])
    from pyspark.ml.functions import vector_to_array
    return out.select(*KEYS, F.size(vector_to_array("features")).alias("n_features"))


@query("I2_train_rf")
def q_i2(spark, sf):
    return _eval(spark, sf, "rf")


@query("I3_train_logreg")
def q_i3(spark, sf):
    return _eval(spark, sf, "logreg")


@query("I4_train_gbt")
def q_i4(spark, sf):
    return _eval(spark, sf, "gbt")


@query("I5_score")
def q_i5(spark, sf):
    model, fs, p = fitted(spark, sf)
    return ml.score(p.test, model, 0.5, fs).select(*KEYS, "delay_probability", "delay_prediction")


@query("I6_evaluate", f"""
WITH d11 AS ({D11_SQL}), d12 AS ({D12_SQL})
SELECT total_matched, accuracy, precision, recall, f1_score, brier_score, true_positives, true_negatives, false_positives, false_negatives,
  actual_delay_rate, pred_delay_rate, roc_auc FROM d11, d12""", ("predictions", "actuals"))
def q_i6(spark, sf):
    """The evaluation itself, over stored scores whose metrics SQL can state (the fitted models' are I2-I4)."""
    return ml.evaluate(matched(spark, sf).withColumn("IS_DELAYED", F.col("actual_is_delayed")))


@query("I7_save_load")
def q_i7(spark, sf):
    model, fs, p = fitted(spark, sf)
    record = ml.run_record(spark, ml.score(p.test, model), p.train.count(), fs, 0.5, AS_OF_FUTURE)
    path = ml.save(model, scratch(spark, "model"), record)
    again, meta = ml.load(path), ml.load_metadata(spark, path).first()
    a = ml.score(p.test, model).select(*KEYS, F.col("delay_probability").alias("p1"))
    b = ml.score(p.test, again, meta["threshold"]).select(*KEYS, F.col("delay_probability").alias("p2"), "delay_prediction")
    same = a.join(b, KEYS).where(F.col("p1") == F.col("p2"))
    return same.select(*KEYS, "delay_prediction", F.lit(meta["features"]).alias("features"), F.lit(meta["rows"]).alias("rows"))


@query("I8_weekly_predict")
def q_i8(spark, sf):
    from skydelay.operators.rows import assign_future_dates
    model, fs, p = fitted(spark, sf)
    g = p.global_rate.first()["global_rate"]
    schedule = assign_future_dates(V(spark, sf, "flights"), None, 7, 42, KEYS, AS_OF_FUTURE)
    return W.weekly_predict(schedule, model, p.rates, g, "2001-10-08", 7, 0.5, AS_OF_FUTURE, out_path=scratch(spark, "predictions"))


@query("I10_weekly_pipeline")
def q_i10(spark, sf):
    model, fs, p = fitted(spark, sf)
    g = p.global_rate.first()["global_rate"]
    return W.weekly_pipeline(V(spark, sf, "flights"), model, p.rates, g, W.SCHEDULE_ROWS, 42, KEYS, AS_OF_FUTURE)


LINEAR = {"MONTH": 0.02, "DAY_OF_WEEK": -0.015, "DISTANCE": 0.0004, "YEAR": 0.05}


@query("I11_explain_linear", f"""
WITH t AS (SELECT * FROM processed WHERE NOT is_train),
m AS (SELECT avg(MONTH) AS MONTH, avg(DAY_OF_WEEK) AS DAY_OF_WEEK, avg(DISTANCE) AS DISTANCE, avg(YEAR) AS YEAR FROM t),
a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [
  {{'abs': abs((t.MONTH - m.MONTH) * 0.02), 'i': 0, 'feature': 'MONTH', 'attribution': (t.MONTH - m.MONTH) * 0.02}},
  {{'abs': abs((t.DAY_OF_WEEK - m.DAY_OF_WEEK) * -0.015), 'i': 1, 'feature': 'DAY_OF_WEEK',
    'attribution': (t.DAY_OF_WEEK - m.DAY_OF_WEEK) * -0.015}},
  {{'abs': abs((t.DISTANCE - m.DISTANCE) * 0.0004), 'i': 2, 'feature': 'DISTANCE',
    'attribution': (t.DISTANCE - m.DISTANCE) * 0.0004}},
  {{'abs': abs((t.YEAR - m.YEAR) * 0.05), 'i': 3, 'feature': 'YEAR', 'attribution': (t.YEAR - m.YEAR) * 0.05}}] AS items
  FROM t, m)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(r AS INTEGER) AS rank, items[r].feature AS feature,
  items[r].attribution AS attribution FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    list_sort(list_transform(items, lambda e: {{'nabs': -e.abs, 'i': e.i, 'feature': e.feature,
      'attribution': e.attribution}})) AS items, unnest(range(1, 4)) AS r FROM a) s""", ("processed",))
def q_i11(spark, sf):
    t = pre(spark, sf).test
    means = {f: t.agg(F.avg(f)).scalar() for f in LINEAR}
    return ml.explain_linear(t, KEYS, LINEAR, means, k=3).select(*KEYS, "rank", "feature", "attribution")


@query("I11_explain_rows")
def q_i11b(spark, sf):
    """Explains every test row. Rows of equal key are told apart by a number, in the order of their features."""
    model, fs, p = fitted(spark, sf)
    again = F.row_number().over(Window.partitionBy(*KEYS).orderBy(*fs.selected))
    t = p.test.withColumn("__n", again).withColumn("__row", F.concat_ws(
        "|", *[F.col(k).cast("string") for k in KEYS], F.when(F.col("__n") > 1, F.col("__n").cast("string"))))
    return ml.explain_rows(t, model, "__row", p.train, fs)
