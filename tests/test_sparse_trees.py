"""Forests from sparse entries against a plain tree on dense rows, and on wide rows."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from radiomap.operators import models, sparse_trees


def plain_tree(x, y, depth, classes):
    """A function of a row: exhaustive greedy splits of dense rows at the middle of neighbouring values."""
    def score(v):
        return sum((v == c).sum() ** 2 for c in range(classes)) / len(v) if classes else v.sum() ** 2 / len(v)

    leaf = float(np.bincount(y.astype(int), minlength=classes).argmax()) if classes else y.mean()
    best = (1e-9, None, None)
    for f in range(x.shape[1]) if depth else ():
        v = np.unique(x[:, f])
        for cut in (v[1:] + v[:-1]) / 2:
            side = x[:, f] <= cut
            gain = (score(y[side]) + score(y[~side]) - score(y)) / len(y)
            if gain > best[0] + 1e-12:
                best = gain, f, cut
    _, f, cut = best
    if f is None:
        return lambda r: leaf
    side = x[:, f] <= cut
    left, right = plain_tree(x[side], y[side], depth - 1, classes), plain_tree(x[~side], y[~side], depth - 1, classes)
    return lambda r: left(r) if r[f] <= cut else right(r)


@pytest.mark.parametrize("classes", [0, 3])
def test_one_tree_is_the_plain_tree(spark, classes):
    draw = random.Random(11)
    x = np.array([[draw.choice([0, 0, 0, -2, 3, 5, 7.5]) for _ in range(5)] + [draw.randrange(20) + 1.0] for _ in range(300)])
    y = x[:, 0] * 2 + (x[:, 1] > 0) * 9 + x[:, 5] + np.array([draw.gauss(0, 1) for _ in x])
    if classes:
        y = np.digitize(y, [8, 14]).astype(float)
    rows = [(k // 2 if k % 7 else None, Vectors.sparse(6, [(i, v) for i, v in enumerate(r) if v]), float(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))]
    data = spark.createDataFrame(rows, ["obs_id", "features", "y"])
    kind = RandomForestClassifier if classes else RandomForestRegressor
    est = kind(labelCol="y", numTrees=1, maxDepth=4, bootstrap=False, featureSubsetStrategy="all", seed=3)
    model = models.fit(est, data, "y")
    want = plain_tree(x, y, 4, classes)
    got = [r["prediction"] for r in model.transform(data.coalesce(1).select("features")).collect()]
    assert np.allclose(sorted(got), sorted(want(r) for r in x)) and len(set(got)) > 2
    tree = model.stages[-1]
    assert tree.trees[0].depth == 4 and abs(sum(tree.featureImportances.toArray()) - 1) < 1e-9


def test_work_follows_the_entries(spark):
    """Two million inputs: laid out, these rows are 12 GB."""
    wide = 2_000_000
    rows = [(k, Vectors.sparse(wide, {k % 3: 5.0, 1_000 + k * 997 % (wide - 1_000): 1.0}), float(k % 3)) for k in range(1_500)]
    data = spark.createDataFrame(rows, ["obs_id", "features", "y"])
    est = RandomForestClassifier(labelCol="y", numTrees=3, maxDepth=3, featureSubsetStrategy="all", seed=3)
    model = models.fit(est, data, "y")
    assert model.transform(data).where("prediction = y").count() == 1_500


def test_bags_and_draws(spark):
    """Rows of one obs_id are drawn apart; a node draws about its share of the inputs."""
    rows = [(7, Vectors.dense([float(k % 2)]), float(k)) for k in range(3_000)]
    data = sparse_trees.binned(models.stable_layout(spark.createDataFrame(rows, ["obs_id", "features", "y"])), "y", "features")
    g = sparse_trees.Growth(20, 0, 0, 1.0, 1, 0.0, True, 5)
    held = sparse_trees.grow(data, g).stats
    assert len(set(held[:, 0])) > 5 and abs(held[:, 0].mean() - 3_000) < 60 and data.n == data.entries * 2 == 3_000
    assert sparse_trees._share("sqrt", 100, 9, True) == sparse_trees._share("auto", 100, 9, True) == 0.1
    assert sparse_trees._share("auto", 90, 9, False) == sparse_trees._share("onethird", 90, 9, False) == 1 / 3
    assert sparse_trees._share("auto", 90, 1, True) == 1 and sparse_trees._share("log2", 64, 9, True) == 6 / 64
    assert sparse_trees._share("0.5", 64, 9, True) == 0.5 and sparse_trees._share("16", 64, 9, True) == 0.25


def test_refuses_broken_classes_and_no_rows(spark):
    rows = spark.createDataFrame([(1, Vectors.dense([1.0]), 0.5)], ["obs_id", "features", "y"])
    with pytest.raises(ValueError):
        models.fit(models.rf_classifier("y", 2, 2), rows, "y")
    with pytest.raises(ValueError):
        models.fit(models.rf_regressor("y", 2, 2), rows.withColumn("y", F.lit(None).cast("double")), "y")
