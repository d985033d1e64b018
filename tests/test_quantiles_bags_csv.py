"""Quantiles, out-of-bag scores and checked CSV files against plain recounts."""

import collections
import random

import numpy as np
import pytest

from radiomap.operators import bagging, quantiles
from radiomap.sources import survey


@pytest.fixture(scope="module")
def values(spark):
    draw = random.Random(4)
    rows = [("big", draw.gauss(0, 1)) for _ in range(30_000)] + [("big", 0.25)] * 4_000 + [("one", 7.0), ("two", 1.0), ("two", 2.0)]
    rows += [(None, float(k)) for k in range(10)] + [("none", None), ("big", None)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(7)


def test_sketch_keeps_its_rank_error(values):
    rows, frame = values
    own = np.sort([v for g, v in rows if g == "big" and v is not None])
    probs = [0.0, 0.01, 0.3, 0.5, 0.77, 0.999, 1.0]
    got = {r["g"]: r for r in quantiles.sketch_quantiles(frame, ["g"], "v", probs, accuracy=200).collect()}
    assert got["none"]["n"] == 0 and got["none"]["quantiles"] is None
    for p, v in zip(probs, got["big"]["quantiles"], strict=True):
        low, high = np.searchsorted(own, v, "left"), np.searchsorted(own, v, "right")
        assert low - len(own) / 200 - 1 <= p * len(own) <= high + len(own) / 200 + 1


@pytest.mark.parametrize("accuracy", [100, 1_000, 1_000_000])
def test_exact_quantiles(values, accuracy):
    rows, frame = values
    probs = [0.0, 0.001, 0.25, 0.5, 0.52, 0.75, 0.9999, 1.0]
    got = {r["g"]: r for r in quantiles.exact_quantiles(frame, ["g"], "v", probs, accuracy).collect()}
    assert set(got) == {"big", "one", "two", None}
    for g, r in got.items():
        own = [v for k, v in rows if k == g and v is not None]
        assert r["n"] == len(own)
        assert np.allclose(r["quantiles"], np.quantile(own, probs), rtol=1e-12, atol=1e-12)


def test_only_the_ranges_are_ordered(spark, values, monkeypatch):
    _, frame = values
    plan = quantiles.exact_quantiles(frame, ["g"], "v", (0.5,), 1_000)._jdf.queryExecution().toString()
    assert "Window" in plan and "CartesianProduct" not in plan
    assert quantiles.exact_quantiles(frame.limit(0), ["g"], "v").count() == 0


def test_out_of_bag_score_is_a_recount(spark):
    from pyspark.ml.linalg import Vectors

    draw = random.Random(6)
    rows = [(k, Vectors.dense([k % 3 + draw.gauss(0, 0.4), draw.random()]), k % 3) for k in range(240)] + [(900, Vectors.dense([0.0, 0.0]), None)]
    train = spark.createDataFrame(rows, ["obs_id", "features", "y"])
    trained, data = bagging.fit_bagged(train, "y", trees=6, max_depth=4)
    votes = bagging.out_of_bag_votes(trained, data)
    bags = {(r["tree"], r["obs_id"]): r["copies"] for r in bagging.bag_table(data, 6).collect()}
    assert len(bags) == 6 * 240
    cast = votes.collect()
    assert {(r["tree"], r["obs_id"]) for r in cast} == {k for k, n in bags.items() if n == 0}
    by = collections.defaultdict(collections.Counter)
    for r in cast:
        by[r["obs_id"]][r["vote"]] += 1
    right = sum(min(c, key=lambda v: (-c[v], v)) == k % 3 for k, c in by.items())
    got = bagging.out_of_bag_score(votes, data, "y").first()
    assert (got["n_scored"], got["n_votes"], got["n_right"]) == (len(by), len(cast), right)
    assert got["score"] > 0.6
    sizes = collections.Counter()
    for (tree, _), n in bags.items():
        sizes[tree] += n
    assert all(170 < n < 310 for n in sizes.values())


def test_checked_csv(spark, tmp_path):
    schema = spark.createDataFrame([], "a int, b string, c double").schema
    (tmp_path / "x.csv").write_text('a,b,c\n1,"u,v",2.5\nx,y,1\n2,z\n\n3,z,1,1\n,,\n4,"p,q",no\n')
    (tmp_path / "y.csv").write_text("a,b,c\n5,k,1e3\n")
    good, faults = survey.read_checked_csv(spark, str(tmp_path), schema)
    assert sorted(map(tuple, good.collect()), key=str) == sorted([(1, "u,v", 2.5), (None, None, None), (5, "k", 1000.0)], key=str)
    found = sorted((r["file"].rsplit("/", 1)[1], r["fault"], r["line"]) for r in faults.collect())
    assert found == [("x.csv", "fields", "2,z"), ("x.csv", "fields", "3,z,1,1"), ("x.csv", "value", '4,"p,q",no'), ("x.csv", "value", "x,y,1")]
    assert {(r["fault"], r["n"]) for r in survey.fault_counts(faults).collect()} == {("fields", 2), ("value", 2)}


@pytest.mark.parametrize("header", ["a,b", "a,c,b", "a,b,c,d"])
def test_other_headers_are_refused(spark, tmp_path, header):
    (tmp_path / "x.csv").write_text(f"{header}\n1,u,2.5\n")
    with pytest.raises(Exception, match="(?i)header"):
        survey.read_checked_csv(spark, str(tmp_path), spark.createDataFrame([], "a int, b string, c double").schema)
