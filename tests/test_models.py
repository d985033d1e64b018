"""Model gates on the fixture (well above chance), persistence, cascade, search."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from radiomap.operators import evaluate, models, search
from radiomap.plans import flows
from radiomap.session import shared_dir
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def data(spark):
    return flows.ml_data(spark, SF_MID)


def _acc(data, est, target):
    p = models.score(models.fit(est, data.train, target), data.test)
    lab = data.obs.select("obs_id", target)
    return evaluate.accuracy(evaluate.scored_table(p, lab, target)).collect()[0]["accuracy"]


def test_forest_building_above_chance(data):
    assert _acc(data, models.rf_classifier("building_id", 20, 10), "building_id") > 0.55  # chance 0.33


def test_forest_floor_above_chance(data):
    assert _acc(data, models.rf_classifier("floor", 20, 10), "floor") > 0.22  # chance 0.20


def test_boosted_longitude_beats_mean(data):
    m = models.fit(models.gbt_regressor("longitude", 20), data.train, "longitude")
    s = evaluate.scored_table(models.score(m, data.test), data.obs.select("obs_id", "longitude"), "longitude")
    mean = data.train.agg(F.avg("longitude")).collect()[0][0]
    base = data.test.agg(F.avg(F.abs(F.col("longitude") - F.lit(mean)))).collect()[0][0]
    assert evaluate.mae(s).collect()[0]["mae"] < 0.85 * base


def test_forest_on_embeddings(spark):
    emb = spark.read.parquet(f"{SF_MID}/embeddings.parquet").select(
        F.col("vec_id").alias("obs_id"), array_to_vector("embedding").alias("features"),
        F.col("label").cast("double").alias("label"))
    pr = models.fit(models.rf_classifier("label", 20, 8), emb, "label").transform(emb)
    assert pr.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).collect()[0][0] > 0.7


def test_save_load_same_predictions(spark, data):
    est = models.rf_classifier("building_id", 5, 6)
    path = shared_dir(spark, "model-test")
    fitted = models.load_or_fit(path, est, data.train, "building_id")
    loaded = models.load_or_fit(path, est, data.train, "building_id")
    a = models.score(fitted, data.test)
    b = models.score(loaded, data.test)
    assert a.exceptAll(b).count() == 0 and a.count() == data.test.count()


def test_seeded_forest_is_reproducible(data):
    est = models.rf_classifier("floor", 5, 6)
    a = models.score(models.fit(est, data.train, "floor"), data.test)
    b = models.score(models.fit(est, data.train.repartition(3), "floor"), data.test)
    assert a.exceptAll(b).count() == 0


def test_cascade_columns(data):
    stages = [("building_id", lambda t, f: models.rf_classifier(t, 5, 6, features=f)),
              ("longitude", lambda t, f: models.rf_regressor(t, 5, 6, features=f))]
    out = models.cascade(data.train, data.test, stages)
    assert set(out.columns) == {"obs_id", "building_id_pred", "longitude_pred"}
    assert out.count() == data.test.count()


def test_random_search_reports_best(data):
    res = search.random_search(models.rf_classifier("floor"), {"numTrees": [3, 5], "maxDepth": [4, 6]},
                               data.train, "floor", n_iter=2, folds=2).collect()
    assert len(res) == 2 and sum(r.best for r in res) == 1


def test_tune_keeps_the_best_model_and_all_its_parameters(data):
    est = models.rf_classifier("floor")
    grid = {"numTrees": [3, 4], "maxDepth": [4, 6], "minInstancesPerNode": [1, 4], "bootstrap": [True, False]}
    found = search.tune(est, grid, data.train, "floor", n_iter=2, folds=2, rows=500)
    best = found.table.filter("best").collect()[0]
    assert {p.name for p in found.params} == set(grid)
    assert f'"numTrees": {found.model.getNumTrees}' in best.params
    again = models.fit(est.copy(found.params), data.train, "floor").stages[-1]
    assert again.getOrDefault("minInstancesPerNode") == found.params[est.getParam("minInstancesPerNode")]


def test_cascade_plan_grows_linearly(data):
    def scans(depth):
        stages = [("building_id", lambda t, f: models.rf_classifier(t, 2, 2, features=f)),
                  ("longitude", lambda t, f: models.rf_regressor(t, 2, 2, features=f)),
                  ("latitude", lambda t, f: models.rf_regressor(t, 2, 2, features=f))]
        plan = models.cascade(data.train, data.test, stages[:depth])._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Relation [")
    assert [scans(k) for k in (1, 2, 3)] == [1, 1, 1]


def test_partitions_follow_the_rows(spark):
    for rows in (1, 1999, 2001, 9000):
        df = spark.range(rows).withColumnRenamed("id", "obs_id")
        assert models.stable_layout(df).rdd.getNumPartitions() == models.train_partitions(rows) == -(-rows // models.ROWS_PER_TASK)


def test_load_or_fit_leaves_what_it_cannot_load(spark, data):
    path = shared_dir(spark, "broken-model")
    spark.range(3).write.parquet(path)
    with pytest.raises(Exception, match="."):
        models.load_or_fit(path, models.rf_classifier("building_id", 2, 2), data.train, "building_id")
    assert spark.read.parquet(path).count() == 3


def test_importances_and_description(data):
    model = models.fit(models.rf_classifier("building_id", 5, 5), data.train, "building_id")
    rows = models.feature_importance(model, data.index).collect()
    assert len(rows) == data.n_features and abs(sum(r.importance for r in rows) - 1) < 1e-6
    assert models.describe(model)["trees"] == 5 and models.describe(model)["classes"] == 3


def test_svm_boosted_and_pca(spark, data):
    from radiomap.operators import features
    from radiomap.operators.boosted import boosted_classes

    assert _acc(data, models.svm_classifier("building_id", max_iter=50), "building_id") > 0.55
    model = boosted_classes(data.train, data.test, "building_id", rounds=6)
    p = models.score(model, data.test)
    acc = evaluate.accuracy(evaluate.scored_table(p, data.obs.select("obs_id", "building_id"), "building_id")).collect()[0]["accuracy"]
    assert acc > 0.55
    got = features.pca_explained(data.train, k=2).collect()
    assert len(got) == 2 and 0 < got[1].explained_variance <= got[0].explained_variance < 1


def test_spark_boosters(data):
    small = data.train.limit(400)
    one = models.fit(models.gbt_classifier("building_id", max_iter=2, max_depth=2), small, "building_id")
    assert models.score(one, data.test).count() == data.test.count()
    two = models.fit(models.gbt_regressor("longitude", max_iter=3, max_depth=2), small, "longitude")
    curve = search.early_stopping_curve(two.stages[-1], data.test, patience=2).collect()
    assert len(curve) == 3 and curve[0].best_iteration >= 1


def test_tuned_flow(spark, monkeypatch):
    from radiomap.plans import queries
    from tests.conftest import SF_SMALL

    monkeypatch.setattr(queries, "FOREST_GRID", {"numTrees": [3, 5], "maxDepth": [4]})
    monkeypatch.setattr(queries, "BOOSTED_GRID", {"max_depth": [3], "learning_rate": [0.2, 0.3], "rounds": [20]})
    monkeypatch.setattr(queries, "FOLDS", 2)
    got = flows.tuned(spark, SF_SMALL)
    p = got.predictions.toPandas()
    assert len(p) == flows.ml_data(spark, SF_SMALL).obs.filter("dataset = 'test'").count()
    assert not p.isna().any().any() and set(p[flows.FLOOR_MODEL]) <= {0.0, 1.0, 2.0, 3.0, 4.0}
    rows = {(r.stage, r.target, r.split, r.metric) for r in got.report.collect()}
    assert len(rows) == 2 * 2 * 4
