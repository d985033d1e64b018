"""Resampling weights and draws against a plain recount."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from radiomap.llm import importance

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def features(text, buckets):
    w = words(text)
    return [zlib.crc32(x.encode()) % buckets for x in w + [" ".join(p) for p in zip(w, w[1:])]]


def plain(rows, target, buckets, least, percent):
    every = [features(t, buckets) for _, t in rows]
    s, t = collections.Counter(b for f in every for b in f), collections.Counter(b for x in target for b in features(x, buckets))
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * (s.total() + buckets) / (float(s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for (i, text), f in zip(rows, every, strict=True):
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def key(r):
    return [(x is None, x or 0) for x in r]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abCDe1é日Ä") for _ in range(draw.randrange(1, 7))) for _ in range(90)]
    out = [(k, draw.choice([" ", "-", "\n", "_ "]).join(draw.choices(vocabulary, weights=range(1, 91), k=draw.randrange(60)))) for k in range(150)]
    return [*out, (None, None), (None, out[4][1]), (7, ""), (9, out[9][1]), (9, out[9][1]), (200, "x " * 40_000), (201, "y" * 70_000 + " z"), (202, "\0!?")]


def test_crcs_of_ngrams(rows):
    texts = [(t or "").encode() for _, t in rows]
    for n, (crc, owner, counts) in enumerate(importance.ngram_crcs(texts, 3), 1):
        want = [(k, zlib.crc32(" ".join(w[i:i + n]).encode())) for k, (_, t) in enumerate(rows) for w in [words(t)] for i in range(len(w) - n + 1)]
        assert list(zip(owner.tolist(), crc.tolist(), strict=True)) == want
        assert counts.tolist() == [len(words(t)) for _, t in rows]


def test_shift_by_any_length():
    draw = random.Random(1)
    sizes = [0, 1, 63, 64, 65, 127, 128, 1000, 4097, 1_000_003]
    a, b = [draw.randbytes(9) for _ in sizes], [draw.randbytes(n) for n in sizes]
    moved = importance.shift(np.array([zlib.crc32(x) for x in a], np.uint32), np.array(sizes))
    assert [m ^ zlib.crc32(y) for m, y in zip(moved.tolist(), b, strict=True)] == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("buckets", [50, 10_000])
def test_same_rows(spark, rows, buckets):
    target = [rows[3][1], rows[8][1] + " éa", None, ""]
    frame = spark.createDataFrame([(*r, 0, "n") for r in rows], "doc_id long, text string, rank int, `row` string").repartition(5)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    got = importance.resample(frame, goal, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, target, buckets, 20, 25), key=key)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    got = sorted(map(tuple, importance.resample(some, none, percent=100).collect()))
    assert got == sorted(plain([(1, "a b " * 20), (2, None)], [], 10_000, 20, 100))
