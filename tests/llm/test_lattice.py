"""Lattice hashing: the decoder, recall at the threshold, and whole results."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiomap.llm import lattice


def test_decoder_finds_the_nearest_point():
    draw = np.random.default_rng(0)
    assert len(lattice.SHORTEST) == 240 and np.allclose((lattice.SHORTEST ** 2).sum(axis=1), 2)
    x = draw.normal(size=(2000, 8)) * 3
    y = lattice.decode(x)
    twice = np.rint(2 * y).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(axis=1)).all() and (np.rint(y.sum(axis=1)) % 2 == 0).all()
    own = ((x - y) ** 2).sum(axis=1)
    for v in lattice.SHORTEST:
        assert (own <= ((x - y - v) ** 2).sum(axis=1) + 1e-9).all()


def brute(ids, vectors, cosine=0.9):
    ok = [v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = np.array([np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else np.zeros(64) for v, k in zip(vectors, ok, strict=True)])
    near = unit @ unit.T >= cosine
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in itertools.combinations(range(len(ids)), 2):
        if near[i, j]:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, int(near[i].sum() - near[i, i]), least[find(i)], least[find(i)] == d) for i, d in enumerate(ids)]


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(8)
    out = [v.tolist() for v in draw.normal(size=(150, 64))]
    for k in range(20):
        for near in (0.02, 0.3):
            out.append((np.array(out[k]) + draw.normal(size=64) * near).tolist())
    out += [out[0]] * 15 + [(np.array(out[1]) * 7.5).tolist()]
    out += [None, [], [0.0] * 64, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] * 64, [1.0] * 5, [1e-300] * 64]
    return out


@pytest.mark.parametrize(("cell", "sent"), [(20_000, 50_000), (4, 50_000), (4, 0)])
def test_groups(spark, vectors, cell, sent, monkeypatch):
    monkeypatch.setattr(lattice, "CELL_ROWS", cell)
    monkeypatch.setattr(lattice, "SENT_CELLS", sent)
    ids = [3 * k + 1 for k in range(len(vectors))]
    rows = [(i, v, 1, "clash") for i, v in zip(ids, vectors, strict=True)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")
    got = sorted(map(tuple, lattice.embedding_groups(frame).collect()))
    want = sorted(brute(ids, vectors))
    links = sum(w[1] for w in want)
    assert sum(g[1] for g in got) >= 0.97 * links and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.95 * len(want)
    lone = [g for g, v in zip(got, vectors, strict=True) if v is None or len(v) != 64]
    assert all(g[1] == 0 and g[2] == g[0] and g[3] for g in lone)


def test_recall_at_the_threshold(spark):
    draw = np.random.default_rng(3)
    a, b = draw.normal(size=(2, 1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    pairs = np.concatenate([a, 0.9005 * a + np.sqrt(1 - 0.9005 ** 2) * b])
    rows = [(k, v.tolist()) for k, v in enumerate(pairs)]
    got = lattice.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.where("n_links > 0").count() >= 0.95 * 3000


def test_ids_and_empty(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01])]
    got = lattice.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id or 0, r.component_id) for r in got) == [(0, None), (1, 1), (1, 1), (2, 1)]
    assert lattice.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pairs_are_counted_once_within_the_tasks(spark, monkeypatch):
    """A group of near copies in hot cells: no pair leaves a task, and no task holds a whole cell."""
    draw = np.random.default_rng(11)
    first = draw.normal(size=64)
    group = [(first + draw.normal(size=64) * 0.02).tolist() for _ in range(600)]
    far = [v.tolist() for v in draw.normal(size=(100, 64))]
    rows = [(k, v) for k, v in enumerate(group + far)] + [(700 + k, group[k]) for k in range(50)]
    monkeypatch.setattr(lattice, "CELL_ROWS", 100)
    got = lattice.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = sorted(brute([r[0] for r in rows], [r[1] for r in rows]))
    assert sorted(map(tuple, got.collect())) == want

    vectors = spark.createDataFrame([(k, k, 1, np.array(v).tobytes()) for k, v in enumerate(group + far)],
                                    "node long, id long, copies long, vector binary")
    sides = lattice.lay_out(vectors, 64, "<f8").groupBy("tab", "cell", "line", "col").agg(
        F.count_if("stores").alias("storing"), F.count_if("probes").alias("probing"))
    assert sides.where("storing > 200 or (storing > 0 and probing > 200)").count() == 0  # 100, but for the deal by hash
    held = lattice.find_links(vectors, 64, "<f8").collect()
    assert len(held) < 600 * 599 / 4 and sum(r.links for r in held) == 600 * 599
