"""Awkward tables: clashing and dotted names, repeated and null ids, hot ids, short items."""

import random

import numpy as np
import pytest

import corpus_pipeline
from radiomap.llm import bpe, decontam, pii, quality, simhash, text
from radiomap.llm.queries import read, tokenizer
from tests.conftest import SF_SMALL

CLASHES = {"found_doc": "int", "found_row": "int", "the_key": "int", "best_doc": "int", "best_row": "int", "a.b": "string", "size": "int", "row": "int",
           "c0": "int", "last": "int", "__key": "int", "__doc": "int", "__row": "int", "__new": "int", "own_text": "int"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [tuple(r) for r in read(spark, SF_SMALL, "documents").collect()]
    odd = [(None, None, None, None, None), (None, "", "en", "web", 0), (None, rows[0][1], "en", None, 5), (rows[1][0], *rows[1][1:]), (rows[1][0], *rows[1][1:]),
           (rows[2][0], "another text " * 30, "xx", "", -3), (9_000_000, "long " * 60_000 + "x@y.zz", "en", "web", 1)]
    names = ", ".join(f"`{c}` {t}" for c, t in CLASHES.items())
    extra = [k if t == "int" else str(k) for k, t in enumerate(CLASHES.values())]
    return spark.createDataFrame([(*r, *extra) for r in rows + odd], f"doc_id long, text string, lang string, source string, n_chars long, {names}")


def rows_of(frame):
    return sorted(map(str, map(tuple, frame.collect())))


def test_every_operator_keeps_columns(spark, docs):
    bench, labels = read(spark, SF_SMALL, "benchmark"), read(spark, SF_SMALL, "labels")
    scored = quality.classify(docs, labels)
    assert scored.columns == [*docs.columns, "text_score", "meta_score", "score", "keep"] and scored.count() == docs.count()
    assert rows_of(scored.select(*[f"`{c}`" for c in docs.columns])) == rows_of(docs)
    kept = simhash.keep_one(docs, size=3, max_bits=2)
    assert kept.columns == docs.columns and set(rows_of(kept)) < set(rows_of(docs))
    groups = simhash.simhash_groups(docs, size=3, max_bits=2)
    assert kept.count() == groups.select("component_id").distinct().count() + 1  # one doc_id names two groups
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns and set(rows_of(clean)) < set(rows_of(docs))
    redacted = pii.redact(docs)
    assert redacted.columns == docs.columns and redacted.count() == docs.count()
    coded = bpe.encode(docs, tokenizer(), digest="digest")
    assert coded.columns == [c for c in docs.columns if c != "text"] + ["ids", "digest"] and coded.count() == docs.count()


def test_pipeline_with_odd_rows(spark, docs):
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF_SMALL).collect(), stage(spark, docs, SF_SMALL).schema)
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] == sizes[4] == sizes[5] > 0
    assert docs.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]


def test_a_hot_id_sends_one_row_to_the_driver(spark):
    draw = random.Random(0)
    rows = [(k, " ".join(draw.choices("abcdef", k=30)), "en", "web", 5) for k in range(60)] + [(3, f"{k} z", "en", "web", 5) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("y", quality.F.lit(1))
    assert quality._feature_rows(docs).count() == 60
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == len(rows)


def test_small_shares_still_draw(spark):
    ids = spark.range(200_000)
    for share in (1e-3, 1e-4):
        got = ids.where(text.sample_condition(share, 3, "id")).count()
        assert 0.5 * share * 200_000 < got < 2 * share * 200_000 + 5
    assert ids.where(text.sample_condition(1.0, 3, "id")).count() == 200_000
    assert "true" not in str(text.sample_condition(1e-12, 3, "id")) and int(1e-12 * 2.0**63) > 0


def test_short_items_are_word_sequences(spark):
    bench = [(1, "Alpha beta"), (2, "gamma"), (3, "alpha, beta gamma delta"), (None, "delta delta"), (5, "!!"), (6, None), (7, "alpha BETA")]
    rows = [(1, "x alpha-beta y"), (2, "beta alpha"), (3, "gamma! gamma"), (4, "alpha"), (5, "beta gamma"), (6, "Alpha Beta Gamma Delta delta"), (None, "gamma"), (8, None)]
    got = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    words = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    want = [(i, j) for i, t in rows for j, b in bench if words(b) and f" {' '.join(words(b))} " in f" {' '.join(words(t))} "]
    assert sorted(map(str, ((r.doc_id, r.item_id) for r in got))) == sorted(map(str, want))
    assert all(r.lcs == 1 and r.answer_found and r.cosine == 0 for r in got)


def test_long_segments_decode_in_runs(monkeypatch):
    field = pii.train()
    draw = random.Random(4)
    segment = [draw.choice(["4111111111111111", "12", "+49", "(030)", "555-1234", "a@b.cc", "10.0.0.1", "x9"]) for _ in range(700)]
    whole = field.features(segment) @ field.emit
    monkeypatch.setattr(pii, "_RUN", 64)
    assert np.allclose(field._weights(segment), whole, atol=1e-9) and len(field._weights([])) == 0
    text_ = "4111111111111111 " * 200_000
    base, every = pii._all_spans([text_], field)
    assert len(base[0]) <= len(every[0])
