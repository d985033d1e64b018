"""SimHash near-duplicates against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from radiomap.llm import simhash


def fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < size else [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, bits):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= bits:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdeÉé") for _ in range(draw.randrange(1, 7)))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "one two"), (6, " ".join(word() for _ in range(30_000)))]
    for k in range(7, 60):
        base = [word() for _ in range(draw.randrange(3, 400))]
        rows.append((10 * k, " ".join(base)))
        for j in range(1, draw.randrange(1, 6)):
            copy = list(base)
            if draw.random() < 0.7:
                copy[draw.randrange(len(copy))] = word()
            rows.append((10 * k + j, "\n".join(copy).upper() if draw.random() < 0.2 else " ".join(copy)))
    rows.append((3, "one"))
    return [(i, t, "clash") for i, t in rows]


@pytest.mark.parametrize("hot", [1, 64])
def test_groups(spark, docs, hot):
    got = simhash.simhash_groups(spark.createDataFrame(docs, "doc_id long, text string, fp string"), hot=hot).collect()
    values = [fingerprint(t) for _, t, _ in docs]
    ids = [d for d, _, _ in docs]
    root = components(values, 2)
    least = {r: min(i for i, q in zip(ids, root, strict=True) if q == r) for r in root}
    want = sorted((i, f"{v:016x}", least[r]) for i, v, r in zip(ids, values, root, strict=True))
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize(("bits", "hot"), [(1, 64), (1, 2), (2, 64), (2, 2)])
def test_links_of_dense_fingerprints(spark, bits, hot):
    draw = random.Random(bits)
    values = set()
    for _ in range(12):
        centre = draw.getrandbits(64) if draw.random() < 0.5 else draw.getrandbits(20)
        values.add(centre)
        for _ in range(25):
            values.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(0, 5))))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits, hot).collect()}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= bits for a, b in found)
    place = {v: i for i, v in enumerate(signed)}
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in found:
        x, y = find(place[a]), find(place[b])
        parent[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(values))] == components(values, bits)


def test_allocation_is_least():
    draw = np.random.default_rng(1)
    for total in (1, 3, 4):
        for parts in (1, 2, 3):
            cost = [np.concatenate([[0.0], np.cumsum(draw.random(total))]) for _ in range(parts)]
            best = min(sum(c[t + 1] for c, t in zip(cost, ts, strict=True)) for ts in itertools.product(range(-1, total), repeat=parts)
                       if sum(t + 1 for t in ts) == total)
            got, ts = simhash.allocate(cost, total)
            assert abs(got - best) < 1e-12 and sum(t + 1 for t in ts) == total


def test_keep_one(spark, docs):
    frame = spark.createDataFrame([*docs, (None, "one", "clash"), (None, None, None)], "doc_id long, text string, fp string")
    kept = simhash.keep_one(frame).collect()
    groups = simhash.simhash_groups(frame).select("component_id").distinct().collect()
    assert sorted(r.doc_id for r in kept) == sorted(g[0] for g in groups)
    assert all(r.fp == "clash" for r in kept)


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(frame).count() == 0 and simhash.keep_one(frame).count() == 0
