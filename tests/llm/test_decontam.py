"""Decontamination: planted passages, edge cases, and recall against brute force."""

import random
import re

import numpy as np
import pytest

from radiomap.llm import decontam

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_subsequence():
    draw = random.Random(0)
    for _ in range(300):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(1, 30))] for _ in range(2))
        assert decontam.lcs_length(a, b) == table(a, b)


def test_all_planted_items_are_found(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    items = {r.item_id: " ".join(words(r.text)) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if f" {t} " in f" {' '.join(words(r.text))} "}
    assert want <= got and len(got - want) <= 0.02 * len(want)


@pytest.fixture(scope="module")
def bench():
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(3, 9)))
    return [(k, " ".join(word() for _ in range(draw.randrange(16, 50))) + ". " + " ".join(word() for _ in range(4))) for k in range(30)]


def test_paraphrases_copies_and_nulls(spark, bench):
    draw = random.Random(2)
    noise = lambda n: " ".join("".join(draw.choice("klmnop") for _ in range(5)) for _ in range(n))

    def changed(text, share, keep):
        w = text.split()
        return " ".join(x if k >= len(w) - keep or draw.random() > share else "zzz" for k, x in enumerate(w))
    rows = [(None, None, 1.0), (0, "", 1.0)]
    rows += [(k + 1, f"{noise(300)} {t} {noise(200)}", 1.0) for k, t in bench]
    rows += [(100 + k, f"{noise(20)} {changed(t, 0.2, 4).upper()} {noise(20)}", 1.0) for k, t in bench]
    rows += [(200 + k, f"{noise(50)} {changed(t, 0.75, 0)} {noise(20)}", 1.0) for k, t in bench]
    rows += [(1000 + k, bench[0][1], 1.0) for k in range(300)]  # one item in most documents
    rows += [(5000, noise(60_000) + " " + bench[3][1], 1.0), (5000, noise(10) + " " + bench[3][1], 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lcs double")
    items = spark.createDataFrame([*bench, (98, None), (None, bench[5][1]), (99, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}
    assert {(k + 1, k) for k, _ in bench} <= got
    assert len({(100 + k, k) for k, _ in bench} & got) >= 27
    assert not {d for d, _ in got} & set(range(200, 230))
    assert {(1000 + k, 0) for k in range(300)} <= got and (5000, 3) in got and (6, None) in got
    left = {r.doc_id for r in decontam.clean(docs, items).collect()}
    assert left == {r[0] for r in rows} - {d for d, _ in got}


def test_the_space_is_fitted_on_all_documents(spark, bench):
    """The map of more than 5,000 documents equals that of a plain matrix of all their passages."""
    draw = random.Random(9)
    own = [w for _, t in bench for w in words(t)]
    rows = [(k, " ".join(draw.choice(own) for _ in range(24))) for k in range(6000)]
    items = decontam.Items(bench)
    weight = 1.0 + np.arange(len(items.vocabulary)) % 3
    got = decontam.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), items, weight)
    passages = []
    for w in [*items.words, *(items.columns(decontam.word_keys([t.encode()], decontam.PUNCTUATION)[0])[a:b] for _, t in rows for a, b in ((0, 16), (16, 24)))]:
        x = np.bincount(w, minlength=len(weight)) * weight
        first = len(passages) < len(items.words)
        passages.append(x / (np.sqrt((x ** 2).sum()) if first else np.sqrt((weight[w] ** 2).sum())))
    a = np.array(passages)
    start = np.random.default_rng(decontam.SEED).standard_normal(got.shape)
    head = a[:len(items.words)]
    want = np.linalg.qr(a.T @ (a @ np.linalg.qr(head.T @ (head @ start) + 1e-3 * start)[0]))[0]
    assert np.allclose(np.linalg.svd(got.T @ want)[1][:20], 1.0, atol=1e-3)


def test_empty(spark, bench):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    assert decontam.leaks(docs.limit(0), items).count() == 0
    assert decontam.leaks(docs, items.limit(0)).count() == 0
    assert decontam.clean(docs, items).count() == 1


def test_paraphrases_without_the_rarest_words(spark):
    """Over 5,000 documents, where all that a paraphrase keeps of its item are common words."""
    draw = random.Random(4)
    prose = lambda n: [f"w{draw.randrange(250)}" for _ in range(n)]
    items = []
    for k in range(20):
        body = prose(10) + [f"rare{k}x{j}" for j in range(8)]
        draw.shuffle(body)
        items.append((k, " ".join(body) + ". " + " ".join(prose(4))))
    rows = [(k, " ".join(prose(40))) for k in range(6000)]
    rows += [(10_000 + k, " ".join(prose(20) + ["zzz" if "rare" in w else w for w in t.split()] + prose(20))) for k, t in items]
    found = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4),
                           spark.createDataFrame(items, "item_id long, text string")).collect()
    text, item = dict(rows), dict(items)
    assert {(10_000 + k, k) for k, _ in items} <= {(r.doc_id, r.item_id) for r in found}
    for r in found:
        a = words(item[r.item_id])
        assert table(a, words(text[r.doc_id])) >= 0.6 * len(a) and r.lcs >= 0.6


def test_no_find_lacks_the_rarest_words():
    draw = random.Random(5)
    items = decontam.Items([(k, " ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(5, 30)))) for k in range(12)])
    rare = decontam.Rare(items, np.array([draw.randrange(50) for _ in items.vocabulary]))
    counts = np.array([0, 3, 17, 90, 1, 140])
    every = np.array([draw.randrange(-2, len(items.vocabulary)) for _ in range(counts.sum())]).clip(-1)
    got = set(zip(*(x.tolist() for x in rare.windows(every, counts, items)), strict=True))
    reached = 0
    for d, (n, begin) in enumerate(zip(counts, np.cumsum(counts) - counts, strict=True)):
        for run in range(-(-n // decontam.STEP)):
            for i, (own, size) in enumerate(zip(items.words, items.sizes, strict=True)):
                at = run * decontam.STEP
                text = every[begin + max(at - size, 0):begin + min(at + decontam.WIDTH + size, n)]
                if table(own.tolist(), text.tolist()) >= decontam.PARAPHRASE * size:
                    assert (d, run, i) in got
                    reached += 1
    assert reached > 20


def test_rows_go_by_their_own_text(spark, bench):
    """A leaking row takes neither rows without id nor rows of the same id with it."""
    leak, other = f"so {bench[0][1]} then", "nothing of any benchmark in here"
    rows = [(None, leak, "a"), (None, other, "a"), (None, None, "b"), (7, leak, "a"), (7, other, "a"), (7, other, "b"), (8, leak, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    left = decontam.clean(docs, items)
    assert left.columns == docs.columns
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(str(r) for r in rows if r[1] != leak)
