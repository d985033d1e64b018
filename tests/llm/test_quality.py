"""Co-trained quality classifier: a plain co-training, held-out accuracy and edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiomap.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 6000")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0
    got = quality.classify(docs, labels.where(seen)).join(labels.where(~seen), "doc_id").select("quality", "keep", "text_score").toPandas()
    assert (got.keep[got.quality == 1]).mean() > 0.98
    assert (~got.keep[got.quality == 0]).mean() > 0.95


def test_edges(spark):
    rows = [(None, None, None, None, None, 1.0), (1, "", "en", "a", 0, 1.0), (1, "", "en", "a", 0, 1.0),
            (2, "x" * 200_000, None, None, -5, 1.0), (3, "the cat " * 50, "en", "a", 400, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 5 and all(r.keep and r.score == 1.0 for r in got)
    one = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (99, 0), (None, 0), (2, None)], "doc_id long, quality int")
    got = quality.classify(docs, one).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(docs.limit(0), one).count() == 0


def test_features_of_whole_texts():
    texts = [b"", b" \n", b"A!! b", "é".encode() * 9, b"word " * 400_000]
    both = quality.text_features(texts)
    alone = np.concatenate([quality.text_features([t]) for t in texts])
    assert np.isfinite(both).all() and np.allclose(both, alone)


def _solve(a, b):
    """Gaussian elimination with pivoting."""
    n = len(b)
    rows = [[*a[i], b[i]] for i in range(n)]
    for i in range(n):
        top = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[top] = rows[top], rows[i]
        for k in range(n):
            if k != i:
                share = rows[k][i] / rows[i][i]
                rows[k] = [x - share * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [rows[i][n] / rows[i][i] for i in range(n)]


class _PlainLogistic:
    def __init__(self, x, y, weight, ridge):
        size = len(x[0])
        self.mean = [sum(r[j] for r in x) / len(x) for j in range(size)]
        self.scale = [max((sum((r[j] - self.mean[j]) ** 2 for r in x) / len(x)) ** 0.5, 1e-6) for j in range(size)]
        self.beta = [0.0] * (size + 1)
        rows = [self.row(r) for r in x]
        penalty = [1e-6, *[ridge] * size]
        for _ in range(30):
            slope = [p * b for p, b in zip(penalty, self.beta, strict=True)]
            bend = [[penalty[i] if i == j else 0.0 for j in range(size + 1)] for i in range(size + 1)]
            for r, t, w in zip(rows, y, weight, strict=True):
                p = 1 / (1 + math.exp(-min(max(sum(a * b for a, b in zip(r, self.beta, strict=True)), -30), 30)))
                for i in range(size + 1):
                    slope[i] += w * (p - t) * r[i]
                    for j in range(size + 1):
                        bend[i][j] += w * max(p * (1 - p), 1e-6) * r[i] * r[j]
            step = _solve(bend, slope)
            self.beta = [b - s for b, s in zip(self.beta, step, strict=True)]
            if max(map(abs, step)) < 1e-6:
                break

    def row(self, r):
        return [1.0, *(min(max((v - m) / s, -8), 8) for v, m, s in zip(r, self.mean, self.scale, strict=True))]

    def logit(self, r):
        return min(max(sum(a * b for a, b in zip(self.row(r), self.beta, strict=True)), -30), 30)


def _plain_co_training(views, y, pool, rounds):
    """Two views, each taught by the other's surest guesses, row by row."""
    fit = [k for k in range(len(y)) if k % 4]
    cal = [k for k in range(len(y)) if k % 4 == 0]
    given = [{}, {}]
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for turn in range(rounds + 1):
        models = []
        for v in (0, 1):
            extra = sorted(given[v])
            models.append(_PlainLogistic([views[v][k] for k in fit] + [pool[v][k] for k in extra], [y[k] for k in fit] + [given[v][k] for k in extra],
                                         [1.0] * len(fit) + [quality.PSEUDO_WEIGHT] * len(extra), 1.0))
        marks = [_PlainLogistic([[models[v].logit(views[v][k])] for k in cal], [y[k] for k in cal], [1.0] * len(cal), 1e-3) for v in (0, 1)]
        view = lambda v, r: marks[v].logit([models[v].logit(r)])  # noqa: E731, B023
        if turn == rounds:
            break
        for v in (0, 1):
            sure = [sigmoid(view(v, r)) for r in pool[v]]
            for c in (1, 0):
                order = sorted(range(len(sure)), key=lambda k: (-sure[k] if c else sure[k], k))[:quality.GIVEN]
                for k in order:
                    if (sure[k] if c else 1 - sure[k]) >= quality.SURE:
                        given[1 - v].setdefault(k, c)
    both = _PlainLogistic([[view(0, views[0][k]), view(1, views[1][k])] for k in cal], [y[k] for k in cal], [1.0] * len(cal), 1e-3)
    assert all(given)
    return [[sigmoid(view(0, a)), sigmoid(view(1, b)), sigmoid(both.logit([view(0, a), view(1, b)]))] for a, b in zip(*pool, strict=True)]


@pytest.mark.parametrize("rounds", [1, 4])
def test_plain_co_training(rounds, monkeypatch):
    """The classifier gives what a plain co-training gives, pseudo-labels included."""
    monkeypatch.setattr(quality, "GIVEN", 6)
    draw = random.Random(rounds)

    def rows(classes):
        return [[[(c - 0.5) * 1.6 + draw.gauss(0, 1) for _ in range(3)] for c in classes], [[(c - 0.5) * 1.6 + draw.gauss(0, 1) for _ in range(2)] for c in classes]]
    y = [draw.randrange(2) for _ in range(80)]
    views, pool = rows(y), rows([draw.randrange(2) for _ in range(150)])
    model = quality.CoTrained([np.array(v) for v in views], np.array(y, float), [np.array(v) for v in pool], rounds)
    got = np.column_stack(model.scores(*(np.array(v) for v in pool)))
    assert np.allclose(got, _plain_co_training(views, y, pool, rounds), atol=1e-6)
    untaught = quality.CoTrained([np.array(v) for v in views], np.array(y, float), [np.array(v) for v in pool], 0)
    assert not np.allclose(got, np.column_stack(untaught.scores(*(np.array(v) for v in pool))), atol=1e-4)


def test_all_rows_take_part_in_the_fit(spark, monkeypatch):
    """Beyond ``POOL`` rows too, whatever their layout: as from all feature rows in one place."""
    monkeypatch.setattr(quality, "POOL", 40)
    monkeypatch.setattr(quality, "GIVEN", 4)
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 9)))

    def text(good):
        return " ".join(draw.choice(quality.STOP_WORDS) if good and draw.random() < 0.4 else word() for _ in range(draw.randrange(20, 60))) + "." + "$|" * draw.randrange(0, 3 if good else 9)
    kinds = [draw.random() < 0.5 for _ in range(500)]
    rows = [(k, text(g), draw.choice("ab"), draw.choice("uv" if g else "vw"), draw.randrange(90, 400)) for k, g in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, int(g)) for k, g in enumerate(kinds) if k % 5 == 0], "doc_id long, quality int")
    views = [quality.text_features([r[1].encode() for r in rows]), quality.meta_features(*([r[j] for r in rows] for j in (2, 3, 4)))]
    y = np.array([float(g) if k % 5 == 0 else np.nan for k, g in enumerate(kinds)])
    held = sorted((k for k in range(len(rows)) if k % 5 == 0), key=lambda k: quality.xxhash.xxh64_intdigest(b"%d" % k))[::4]
    part = views, y, np.isin(np.arange(len(rows)), held)
    want = quality.CoTrained.over(lambda fn: fn(part))
    got = quality.train(docs.repartition(5), labels)
    assert np.allclose(got.scores(*views), want.scores(*views), atol=1e-6)
    monkeypatch.setattr(quality, "POOL", 400)
    assert not np.allclose(quality.train(docs, labels).scores(*views), got.scores(*views), atol=1e-6)
