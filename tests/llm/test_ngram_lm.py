"""Language-model scores against a plain implementation of the model."""

import collections
import math
import random

import numpy as np
import pytest

from radiomap.llm import ngram_lm


def plain(rows, held):
    texts = [(t or "").encode().lower().split() + [None] for _, t in rows]
    train = [t for t, h in zip(texts, held, strict=True) if not h]
    count = collections.Counter(w for t in train for w in t)
    total, half = sum(count.values()), 0.5 * (len(count) + 1)
    seen3 = collections.Counter(x for t in train for x in zip(["<s>", "<s>", *t], ["<s>", *t], t, strict=False))
    seen2 = collections.Counter((u, w) for _, u, w in seen3)  # continuation counts
    seen1 = collections.Counter(w for _, w in seen2)

    def order(counts):
        by = collections.Counter(counts.values())
        d = ngram_lm.discounts(by[1], by[2], by[3], by[4])
        total_of, mass_of = collections.Counter(), collections.Counter()
        for gram, n in counts.items():
            total_of[gram[:-1]] += n
            mass_of[gram[:-1]] += d[min(n, 3)]

        def p(gram, lower):
            context = gram[:-1]
            if not total_of[context]:
                return lower
            n = counts[gram]
            return ((n - d[min(n, 3)]) * (n > 0) + mass_of[context] * lower) / total_of[context]
        return p
    high, mid = order(seen3), order(seen2)

    def p(v, u, w):
        return high((v, u, w), mid((u, w), (seen1[w] + 0.5) / (len(seen2) + half)))
    out = []
    for (i, _), t, h in zip(rows, texts, held, strict=True):
        history = ["<s>", "<s>", *t]
        score = sum(math.log10(p(*history[k:k + 3])) for k in range(len(t)))
        base = sum(math.log10((count[w] + 0.5) / (total + half)) for w in t)
        out.append((i, h, len(t), sum(count[w] > 0 for w in t), total, base, score))
    return out, p, [*count, "unknown"]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    vocabulary = ["".join(draw.choice("abcdEé") for _ in range(draw.randrange(1, 6))) for _ in range(60)]
    out = [(k, " ".join(draw.choices(vocabulary, weights=range(1, 61), k=draw.randrange(0, 60)))) for k in range(80)]
    return [*out, (None, None), (3, out[3][1]), (3, out[3][1]), (900, "z " * 50_000), (901, "\x1c\x85 \x0b")]


@pytest.mark.parametrize(("condition", "tokens", "fan", "block"), [
    ("doc_id % 5 = 1", 20_000, 512, 12 << 20), ("false", 20_000, 512, 12 << 20), ("true", 20_000, 512, 12 << 20),
    ("doc_id % 5 = 1", 3_000, 3, 1_000)])  # the last: three levels of ranges, relays between them
def test_scores(spark, rows, condition, tokens, fan, block, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BUCKET_TOKENS", tokens)
    monkeypatch.setattr(ngram_lm, "FAN", fan)
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", block)
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(4)
    got = sorted(map(tuple, ngram_lm.score(frame, condition).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    held = [{"false": False, "true": True}.get(condition, i is not None and i % 5 == 1) for i, _ in rows]
    want, p, words = plain(rows, held)
    want.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    if condition != "true":
        for v, u in (("<s>", "<s>"), ("<s>", words[0]), (words[0], words[1]), ("never", "seen")):
            assert abs(sum(p(v, u, w) for w in words) - 1) < 1e-9


def test_empty(spark):
    assert ngram_lm.score(spark.createDataFrame([], "doc_id long, text string"), "true").count() == 0


def test_requests_have_a_bounded_number_of_rows():
    keys = np.sort(np.random.default_rng(1).integers(0, 2 ** 64 - 1, 50_000, np.uint64))
    ones = np.ones(len(keys), np.int64)
    top = list(ngram_lm._ask(ngram_lm.TRIGRAMS, 7, 0, 16, 16, keys, ones))
    assert len(top) == 16
    asked = ngram_lm._Requests(ngram_lm.pa.Table.from_pylist([top[5], {**top[5], "node": 8}], ngram_lm._ASK))
    below = list(ngram_lm._ask(asked.kind, 0, asked.lane, 16, 256, asked.keys, asked.sums))
    assert [r["lane"] for r in below] == list(range(80, 96))
    assert (asked.sums == 2).all() and len(asked.keys) == np.sum((keys >> np.uint64(60)) == 5)
