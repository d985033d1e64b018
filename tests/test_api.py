"""Public helper names over small scored tables."""

from pyspark.sql import functions as F

from radiomap import api
from radiomap.operators import clean


def _scored(spark):
    rows = [(1, "test", "floor", 0.0, 0.0), (2, "test", "floor", 1.0, 0.0), (3, "test", "floor", 1.0, 1.0),
            (4, "test", "floor", 2.0, 2.0)]
    return spark.createDataFrame(rows, "obs_id long, split string, target string, actual double, predicted double")


def test_acc_report(spark):
    rep = api.acc_report(_scored(spark))
    assert rep["accuracy"].collect()[0]["accuracy"] == 0.75
    assert rep["confusion"].count() == 4
    assert 0 < rep["kappa"].collect()[0]["kappa"] < 1


def test_errors(spark):
    s = _scored(spark).withColumn("target", F.lit("longitude"))
    assert api.mae_report(s).collect()[0]["mae"] == 0.25
    assert sorted(r.error for r in api.find_error(s).collect()) == [-1.0, 0.0, 0.0, 0.0]


def test_set_y_and_positions(spark):
    df = spark.createDataFrame([(1, 0.5, 2)], "obs_id long, x double, floor int")
    df = df.withColumn("features", F.array("x"))
    out = api.set_y(df, "floor")
    assert out.columns == ["obs_id", "features", "label"] and out.collect()[0].label == 2.0
    assert clean.select_by_position(df, 1, 3, keep=("obs_id",)).columns == ["obs_id", "x", "floor"]


def test_model_helpers_end_to_end(spark):
    from radiomap.operators import models
    from radiomap.plans import flows
    from tests.conftest import SF_SMALL

    d = flows.ml_data(spark, SF_SMALL)
    rep = api.rfc_pred(models.fit(models.rf_classifier("floor", 5, 4), d.train, "floor"), d.test, "floor")
    assert rep["confusion"].count() > 0 and 0 <= rep["accuracy"].collect()[0]["accuracy"] <= 1
    assert api.xgb_fit(d.train, d.test, "latitude", rounds=3, max_depth=3).best <= 3
    unlabeled = d.test.select("obs_id", "features")
    grid = {"max_depth": [3], "learning_rate": [0.3], "rounds": [5], "least_rows": [4.0], "patience": [50]}
    out = api.lat_long_reg(d.train, d.test, d.train, unlabeled, "latitude", grid, n_iter=1, folds=2)
    assert out["search"].count() == 1 and out["curve"].count() == 5
    assert '"least_rows": 4.0' in out["search"].first()["params"]
    assert out["predictions"].count() == d.test.count()
