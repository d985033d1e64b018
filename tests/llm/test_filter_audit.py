"""The document-term matrix and the audit of all filter orders against plain recounts."""

import collections
import itertools
import random

import numpy as np
import pytest

from radiomap.llm import filter_audit


def letters(rows):
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, _, t in rows:
        t = t or ""
        w = t.encode().split()
        yield "".join(c for c, fails in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            bool(set(t) & set("#$%&*|")), i is not None and i > least[t]), strict=True) if fails)


def plain(rows, labels):
    good, toxic = ({i for i, *q in labels if q[k] == 1} for k in (0, 1))
    parts = collections.defaultdict(list)
    for (i, s, _), f in zip(rows, letters(rows), strict=True):
        parts[s or ""].append((f, i in good and i is not None, i in toxic and i is not None))
    out = []
    for part, docs in parts.items():
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for f, _, _ in docs:
                shapley.update([c for c in order if c in f][:1])
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, c in enumerate(order, 1):
                here = [d for d in left if c in d[0]]
                kept = [d for d in left if c not in d[0]]
                redundant = sum(c in d[0] for d in docs) - len(here)
                out.append((part, "".join(order), step, len(kept), len(here), redundant, sum(d[0] == c for d in docs),
                            sum(d[1] for d in here), sum(d[2] for d in here), shapley[c]))
                left = kept
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    texts = []
    for k in range(90):
        vocabulary = [f"{'W' if draw.random() < 0.1 else 'w'}{j}" for j in range(draw.choice([40, 120, 400]))]
        texts.append(draw.choice([" ", "\n", "\t\x0b", "\x1c "]).join(draw.choices(vocabulary, k=draw.choice([5, 199, 200, 260])))
                     + draw.choice(["", "", " 5 %", "\x85é"]))
    out = [(k, draw.choice(["web", "forum", None, ""]), t) for k, t in enumerate(texts)]
    out += [(100 + k, draw.choice(["web", "news"]), texts[draw.randrange(4)]) for k in range(40)]
    return [*out, (None, "web", None), (None, None, texts[0]), (500, "web", ""), (501, "web", None), (3, "web", texts[3]),
            (3, "web", texts[3]), (600, "long", "word" * 60_000), (601, "long", "a b " * 60_000)]


LABELS = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 120, 2)] + [(4, 0, 1), (4, 1, None), (None, 1, 1), (5, None, None), (999, 1, 1)]


@pytest.mark.parametrize("block", [1 << 12, 1 << 24])
def test_every_order(spark, rows, block, monkeypatch):
    monkeypatch.setattr(filter_audit, "BLOCK_BYTES", block)
    docs = spark.createDataFrame([(i, t, s, 1, "x") for i, s, t in rows], "doc_id long, text string, source string, fails int, `part.n` string").repartition(4)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain(rows, LABELS)


def test_matrix(spark, rows, monkeypatch):
    monkeypatch.setattr(filter_audit, "BLOCK_BYTES", 1 << 13)
    docs = spark.createDataFrame([(i, t, s) for i, s, t in rows], "doc_id long, text string, source string").repartition(3)
    shards, dictionary = filter_audit.matrix(docs)
    entries = dictionary.collect()
    word = {r.column: bytes(r.word) for r in entries}
    assert len(word) == len(entries) == len({w for _, _, t in rows for w in (t or "").encode().split()})
    got = []
    for s in shards.collect():
        starts, columns, counts = np.frombuffer(s.starts, np.int64), np.frombuffer(s.columns, np.int64), np.frombuffer(s.counts, np.int32)
        for i, a, b in zip(s.doc_ids, starts, starts[1:]):
            got.append((i, collections.Counter({word[c]: n for c, n in zip(columns[a:b].tolist(), counts[a:b].tolist())})))
    want = [(i, collections.Counter((t or "").encode().split())) for i, _, t in rows]
    order = lambda x: (str(x[0]), sorted(x[1].items()))
    assert sorted(got, key=order) == sorted(want, key=order)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], docs.schema), labels).collect()
    assert sorted(map(tuple, one)) == plain([(1, None, None)], [])
