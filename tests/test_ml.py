import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from skydelay.plans import jobs, ml
from skydelay.plans import fixtures as FX


def test_train_score_save_load_logreg(spark):
    p = jobs.preprocess(FX.view(spark, SF_SMALL, "flights"), FX.view(spark, SF_SMALL, "airports_raw"),
                        FX.view(spark, SF_SMALL, "airlines"))
    model, fs = ml.train(p.train, "logreg", max_iter=50)
    assert fs.categorical == ["TIME_OF_DAY", "SEASON", "AIRLINE"] and len(fs.numeric) == 10
    scored = ml.score(p.test, model, 0.5, fs)
    assert scored.count() == p.test.count()
    bad = scored.where((F.col("delay_probability") < 0) | (F.col("delay_probability") > 1)).count()
    assert bad == 0
    path = ml.save(model, tempfile.mkdtemp() + "/m")
    again = ml.score(p.test, ml.load(path))
    a = {r[0] for r in scored.select(F.round("delay_probability", 12)).collect()}
    b = {r[0] for r in again.select(F.round("delay_probability", 12)).collect()}
    assert a == b
    rep = ml.evaluate(scored).first()
    assert rep.total_matched == p.test.count() and rep.roc_auc is not None


def test_encodings_come_from_train_only(spark):
    p = jobs.preprocess(FX.view(spark, SF_SMALL, "flights"), FX.view(spark, SF_SMALL, "airports_raw"),
                        FX.view(spark, SF_SMALL, "airlines"))
    n_train = p.train.count()
    total = sum(r.n for r in p.rates.where("rate = 'CARRIER_DELAY_RATE'").collect())
    assert total == n_train


def test_evaluation_scores_each_row_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def scored(i):
        seen.add(1)
        return (i * 7 % 10) / 10

    rows = spark.range(50).select((F.col("id") % 3 == 0).cast("int").alias("IS_DELAYED"), scored("id").alias("delay_probability")) \
        .withColumn("delay_prediction", (F.col("delay_probability") >= 0.5).cast("int"))
    got = ml.evaluate(rows).first()
    assert seen.value == 50
    pairs = [((i * 7 % 10) / 10, i % 3 == 0) for i in range(50)]
    beats = [(p > q) + (p == q) / 2 for p, y in pairs if y for q, z in pairs if not z]
    assert got.total_matched == 50 and abs(got.roc_auc - sum(beats) / len(beats)) < 1e-12
    assert got.true_positives == sum(y and p >= 0.5 for p, y in pairs)
