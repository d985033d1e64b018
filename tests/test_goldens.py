"""Accuracy and Cohen's kappa of the eight published confusion matrices."""

import pytest

from radiomap.operators import evaluate

GOLDEN = [
    ([[359, 8, 3, 0, 0], [1, 349, 1, 0, 0], [0, 2, 357, 4, 0], [0, 0, 3, 351, 1], [0, 1, 0, 1, 119]],
     0.9839743589743589, 0.9794845681869829),
    ([[52, 6, 2, 0, 0], [0, 60, 0, 0, 0], [0, 2, 56, 2, 0], [0, 0, 2, 57, 1], [0, 1, 0, 1, 18]],
     0.9346153846153846, 0.9162244124336618),
    ([[369, 1, 0, 0, 0], [0, 351, 0, 0, 0], [0, 0, 362, 1, 0], [0, 0, 0, 355, 0], [0, 0, 0, 0, 121]],
     0.9987179487179487, 0.9983588371098491),
    ([[60, 0, 0, 0, 0], [0, 60, 0, 0, 0], [0, 0, 59, 1, 0], [0, 0, 0, 60, 0], [0, 0, 0, 0, 20]],
     0.9961538461538462, 0.9950757575757576),
    ([[1218, 10, 0, 0, 0], [5, 1307, 3, 0, 0], [1, 0, 1258, 3, 0], [0, 0, 3, 1230, 0], [0, 0, 0, 1, 411]],
     0.9952293577981651, 0.9938873805294564),
    ([[24, 4, 0, 0, 0], [1, 111, 3, 0, 0], [0, 0, 59, 3, 0], [0, 0, 1, 32, 0], [0, 0, 0, 1, 11]],
     0.948, 0.925027105584904),
    ([[1228, 0, 0, 0, 0], [0, 1315, 0, 0, 0], [0, 0, 1262, 0, 0], [0, 0, 0, 1233, 0], [0, 0, 0, 0, 412]],
     1.0, 1.0),
    ([[28, 0, 0, 0, 0], [0, 115, 0, 0, 0], [0, 0, 62, 0, 0], [0, 0, 0, 33, 0], [0, 0, 0, 0, 12]], 1.0, 1.0),
]


def _cm(spark, m):
    rows = [("floor", "test", a, p, n) for a, r in enumerate(m) for p, n in enumerate(r) if n]
    return spark.createDataFrame(rows, "target string, split string, actual int, predicted int, n long")


def _scored(spark, m):
    rows = [(i, "test", "floor", float(a), float(p))
            for i, (a, p) in enumerate((a, p) for a, r in enumerate(m) for p, n in enumerate(r) for _ in range(n))]
    return spark.createDataFrame(rows, "obs_id long, split string, target string, actual double, predicted double")


@pytest.mark.parametrize("m,acc,kappa", GOLDEN)
def test_kappa_from_matrix(spark, m, acc, kappa):
    got = evaluate.kappa_from_confusion(_cm(spark, m), digits=None).collect()[0]["kappa"]
    assert abs(got - kappa) < 1e-12


@pytest.mark.parametrize("m,acc,kappa", GOLDEN[:2])
def test_metrics_from_scored_rows(spark, m, acc, kappa):
    s = _scored(spark, m)
    assert abs(evaluate.accuracy(s, digits=None).collect()[0]["accuracy"] - acc) < 1e-12
    assert abs(evaluate.cohen_kappa(s, digits=None).collect()[0]["kappa"] - kappa) < 1e-12
    cm = {(r.actual, r.predicted): r.n for r in evaluate.confusion_matrix(s).collect()}
    assert cm == {(a, p): n for a, r in enumerate(m) for p, n in enumerate(r) if n}


def test_kappa_single_class_is_null(spark):
    cm = spark.createDataFrame([("floor", "test", 2, 2, 10)],
                               "target string, split string, actual int, predicted int, n long")
    assert evaluate.kappa_from_confusion(cm).collect()[0]["kappa"] is None
