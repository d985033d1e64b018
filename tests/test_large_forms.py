"""Forms of PCA, SVM, forests and draws that need neither dense vectors nor one task."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import StandardScaler
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiomap.operators import features, models, sampling
from radiomap.plans import flows
from radiomap.plans.queries import QUERIES
from radiomap.session import shared_dir
from radiomap.sources import fixtures
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def data(spark):
    return flows.ml_data(spark, SF_SMALL)


def frame(spark, rows):
    return spark.createDataFrame([(k, r) for k, r in enumerate(rows)], T.StructType([T.StructField("obs_id", T.LongType()), T.StructField("features", VectorUDT())]))


@pytest.mark.parametrize("block", [2, 8])
def test_pca_equals_the_covariance(spark, block, monkeypatch):
    monkeypatch.setattr(features, "MATRIX_ROWS", 7)
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, 20)) * draw.integers(1, 50, 20) * (draw.random((300, 20)) < 0.4)
    x[:, 3] = x[:, 4] * 2 + draw.normal(size=300) * 0.1
    x[:, 7], x[:, 11] = 5.0, 0.0  # constant columns
    rows = [Vectors.dense(r) if k % 3 == 0 else Vectors.sparse(20, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for k, r in enumerate(x)]
    got = features.pca_explained(frame(spark, rows).repartition(5), k=4, block=block, steps=20).orderBy("component").collect()
    use = x.std(axis=0) > 0
    z = (x[:, use] - x[:, use].mean(axis=0)) / x[:, use].std(axis=0, ddof=1)
    w = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    assert np.allclose([r.explained_variance for r in got], (w / w.sum())[:4], atol=1e-8)


def test_pca_without_variance(spark):
    same = frame(spark, [Vectors.sparse(3, [0], [2.0])] * 4)
    assert [r.explained_variance for r in features.pca_explained(same, k=2).collect()] == [0.0, 0.0]
    assert features.pca_explained(same.limit(0), k=2).count() == 0


def test_svm_on_sparse_vectors_answers_as_on_centred_ones(data):
    dense = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True), OneVsRest(
        classifier=LinearSVC(maxIter=400, regParam=0.01, tol=1e-6), labelCol="building_id", featuresCol="_scaled")])
    a, b = (models.fit(e, data.train, "building_id") for e in (dense, models.svm_classifier("building_id", max_iter=400, tol=1e-6)))
    both = models.score(a, data.test, "p").join(models.score(b, data.test, "q"), "obs_id")
    assert both.agg(F.avg((F.col("p") == F.col("q")).cast("double"))).first()[0] > 0.99
    scaled = b.stages[0].transform(data.test).select("_scaled").first()[0]
    assert type(scaled).__name__ == "SparseVector"


def test_trees_as_a_relation(spark, data):
    model = models.fit(models.rf_regressor("latitude", num_trees=4, max_depth=6), data.train, "latitude")
    path = shared_dir(spark, "trees")
    models.save_model(model, path)
    trees = models.tree_table(spark, path, data.index)
    assert trees.count() == models.describe(model)["nodes"] and trees.select("tree").distinct().count() == 4
    entries = features.vector_entries(data.test).join(data.index, "idx").select("obs_id", "ap_id", "x")
    got = models.score_by_trees(trees, data.test.select("obs_id"), entries, 6)
    both = got.join(models.score(model, data.test, "own"), "obs_id")
    assert both.count() == data.test.count() and both.where(F.abs(F.col("prediction") - F.col("own")) > 1e-6).count() == 0


@pytest.mark.parametrize("frac", [0.0, 0.3, 1.0, 2.5])
def test_draws_with_replacement_have_the_exact_size(spark, frac):
    ids = spark.range(333).withColumnRenamed("id", "obs_id").repartition(4)
    got = sampling.bootstrap_exact(ids, frac, salt="t")
    assert got.count() == sampling.round_half_even(frac * 333)
    assert got.groupBy("obs_id").agg(F.max("copy_no").alias("m"), F.count("*").alias("n")).where("m <> n").count() == 0
    assert got.exceptAll(sampling.bootstrap_exact(ids.repartition(2), frac, salt="t")).count() == 0


def test_draws_from_nothing(spark):
    assert sampling.bootstrap_exact(spark.range(0).withColumnRenamed("id", "obs_id"), 0.5).count() == 0


def test_entries_come_from_what_vectors_store(spark):
    """Stored zeros and nulls are no entries, ids and order are kept, and a vector's length costs nothing."""
    from radiomap.operators import features

    rows = spark.createDataFrame([(1, [(3, 2.5), (2_000_000_000, 1.0)]), (2, [(0, 0.0), (5, None)]), (3, None), (None, [(7, 4.0)])],
                                 "obs_id long, _entries array<struct<idx:int,x:double>>")
    got = features.vector_entries(features.as_vectors(rows, 2_100_000_000))
    assert got.schema.simpleString() == "struct<obs_id:bigint,idx:int,x:double>"
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 3, 2.5), (1, 2_000_000_000, 1.0), (None, 7, 4.0)], key=str)


def test_silent_rows_are_not_spread_over_their_columns(spark):
    from radiomap.operators import reshape

    rows = [(1, None, 100, 100), (2, 100, 100, -7), (3, None, None, None), (4, -60, 100, None)]
    wide = spark.createDataFrame(rows, "obs_id long, WAP1 int, WAP2 int, WAP3 int")
    aps = ["WAP1", "WAP2", "WAP3"]
    long = reshape.wide_to_long(wide, ["obs_id"], aps)
    assert sorted(map(tuple, long.collect())) == [(2, "WAP3", -7), (4, "WAP1", -60)]
    plain = reshape.wide_to_long(wide, ["obs_id"], aps, sentinel=None)
    assert plain.count() == 7
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan.split("Expand", 1)[1]


def test_scans_by_panels_are_not_shuffled(spark):
    """The rows of a wide survey are laid out where the scan is: no exchange or join above the explosion."""
    from radiomap.sources import fixtures as fx
    from tests.conftest import SF_SMALL

    plan = fx.scan_wide(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(plan) if "Generate explode" in line)
    assert not any("Join" in line or "Aggregate" in line for line in plan[:at])


def test_panels_are_dealt_by_the_rows_of_the_line_table(spark, monkeypatch):
    whole = QUERIES["long_to_wide"](spark, SF_SMALL)
    monkeypatch.setattr(fixtures, "PANEL_LINES", 100)
    dealt = QUERIES["long_to_wide"](spark, SF_SMALL)
    parts = -(-spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count() // 100)
    assert parts > spark.sparkContext.defaultParallelism and dealt.rdd.getNumPartitions() == parts
    assert whole.count() > 0 and whole.exceptAll(dealt).count() == dealt.exceptAll(whole).count() == 0


def test_a_linear_model_sends_no_more_than_its_rows(spark, monkeypatch):
    """Gradients are as wide as the inputs, so partitions times inputs stay within the rows."""
    for rows, width in ((1_000, 10), (90_000, 6_000), (900_000, 60_000), (5_400_000, 360_000)):
        assert (models.linear_partitions(rows, width) - 1) * width < rows
    assert models.linear_partitions(0, 5) == 1 and models.linear_partitions(9_000, 10) == models.train_partitions(9_000)
    laid = []
    layout = models.stable_layout
    monkeypatch.setattr(models, "stable_layout", lambda df, n=None: laid.append(n) or layout(df, n))
    monkeypatch.setattr(models, "ROWS_PER_TASK", 2)
    rows = [(k, Vectors.sparse(20, [k % 20], [1.0 + k]), float(k % 2)) for k in range(40)]
    kind = T.StructType([T.StructField("obs_id", T.LongType()), T.StructField("features", VectorUDT()), T.StructField("y", T.DoubleType())])
    models.fit(models.svm_classifier("y", max_iter=3), spark.createDataFrame(rows, kind), "y")
    models.fit(models.rf_classifier("y", num_trees=1), spark.createDataFrame(rows, kind), "y")
    assert laid == [2, None]
