from conftest import SF_SMALL
from skydelay.plans import queries_ml


def test_every_test_row_is_explained(spark, monkeypatch):
    fitted = queries_ml.fitted(spark, SF_SMALL, "logreg")  # which model it is does not matter here
    monkeypatch.setattr(queries_ml, "fitted", lambda *_: fitted)
    n = fitted[2].test.count()
    assert n > 200
    per = queries_ml.q_i11b(spark, SF_SMALL).groupBy("__row").count().collect()
    assert len(per) == n and {r["count"] for r in per} == {5}
