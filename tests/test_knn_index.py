"""The pivot index: the same neighbours as brute force, and few groups visited."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiomap.operators import knn


@pytest.fixture(scope="module")
def places(spark):
    """(reading, rows by scan): 40 places that hear APs of their own, and one place that
    a third of all training scans share; some scans hear nothing."""
    draw = np.random.default_rng(4)
    rows = {}
    for i in range(900):
        place = 0 if i % 3 == 0 else 1 + i % 40
        rows[i] = {f"WAP{place * 5 + j:04d}": int(-60 + draw.integers(-3, 4) * (place > 0) + 9 * j) for j in range(5)} if i % 97 else {}
    reading = spark.createDataFrame([(i, a, x) for i, r in rows.items() for a, x in r.items()], "obs_id long, ap_id string, rssi int")
    return reading, rows


def brute(rows, queries, train, k):
    aps = sorted({a for r in rows.values() for a in r})
    dense = np.array([[rows[i].get(a, -110) + 110 for a in aps] for i in sorted(rows)])
    out = []
    for q in queries:
        d = ((dense[train] - dense[q]) ** 2).sum(axis=1)
        order = sorted(range(len(train)), key=lambda j: (d[j], train[j]))[:k]
        out += [(q, train[j], int(d[j]), n + 1) for n, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize(("k", "tile"), [(3, 50), (1, 1000), (7, 20)])
def test_same_as_brute_force_with_few_visits(spark, places, monkeypatch, k, tile):
    reading, rows = places
    monkeypatch.setattr(knn, "TILE_SCANS", tile)
    monkeypatch.setattr(knn, "PIVOT_SCANS", 12)
    monkeypatch.setattr(knn, "_ROWS", 16)
    ids = spark.createDataFrame([(i,) for i in rows], "obs_id long")
    queries, train = [i for i in rows if i % 10 == 1], [i for i in rows if i % 10 != 1]
    q, t = (knn._vectors(ids.where(c), reading, -110) for c in ("obs_id % 10 = 1", "obs_id % 10 <> 1"))
    got, paid = knn.indexed_neighbors(q, t, len(train), k)
    assert sorted(map(tuple, got.collect())) == brute(rows, queries, train, k)
    pivots = -(-len(train) // 12)
    visits = paid.count()
    assert visits == paid.distinct().count() and visits < 0.25 * pivots * len(queries)


def test_used_for_many_scans_only(spark, places, monkeypatch):
    reading, rows = places
    ids = spark.createDataFrame([(i,) for i in rows], "obs_id long")
    q, t = ids.where("obs_id % 10 = 1"), ids.where("obs_id % 10 <> 1")
    plain = sorted(map(tuple, knn.knn_neighbors(q, t, reading).collect()))
    monkeypatch.setattr(knn, "TILE_SCANS", 10)
    monkeypatch.setattr(knn, "PIVOT_SCANS", 40)
    called = []
    inner = knn.indexed_neighbors
    monkeypatch.setattr(knn, "indexed_neighbors", lambda *a: called.append(1) or inner(*a))
    assert sorted(map(tuple, knn.knn_neighbors(q, t, reading).collect())) == plain and called
    few = t.where("obs_id < 3")
    assert knn.knn_neighbors(q, few, reading, k=5).groupBy("query_id").count().where("count <> 2").count() == 0


def test_fewer_scans_than_neighbours_and_none(spark, places, monkeypatch):
    reading, rows = places
    ids = spark.createDataFrame([(i,) for i in rows], "obs_id long")
    q = knn._vectors(ids.where("obs_id < 5"), reading, -110)
    got, _ = knn.indexed_neighbors(q, knn._vectors(ids.where("obs_id in (7, 8)"), reading, -110), 2, 3)
    assert sorted(map(tuple, got.collect())) == brute(rows, range(5), [7, 8], 3)
    assert got.agg(F.count("*")).first()[0] == 10


def test_products_follow_the_entries_that_meet(monkeypatch):
    """Sparse and dense products agree, and rows over a wide catalogue take no dense piece of it."""
    draw = np.random.default_rng(1)
    rows, others, columns = 9, 7, 50
    dense = [draw.integers(-5, 6, (n, columns)) * (draw.random((n, columns)) < 0.3) for n in (rows, others)]
    q, t = ((*np.nonzero(d), d[np.nonzero(d)].astype(float)) for d in dense)
    want = dense[0] @ dense[1].T
    for meetings in (0, 10**6):
        monkeypatch.setattr(knn, "_MEETINGS", meetings)
        assert (knn._products(q, t, rows, others, columns) == want).all()
    monkeypatch.setattr(knn, "_dense", None)
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    assert not knn._products(none, none, 3, 2, 0).any()
    assert knn._products(q, t, rows, others, columns).tolist() == want.tolist()


@pytest.mark.parametrize("k", [1, 3, 20])
def test_least_by_distance_then_id(k):
    draw = np.random.default_rng(2)
    d, ids = draw.integers(0, 4, (6, 11)).astype(float), np.stack([draw.permutation(11) for _ in range(6)])
    order = np.lexsort((ids, d), axis=1)[:, :k]
    got = knn._least(d, ids, k)
    assert (got[0] == np.take_along_axis(d, order, 1)).all() and (got[1] == np.take_along_axis(ids, order, 1)).all()
