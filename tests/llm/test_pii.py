"""Base patterns against plain regular expressions; the field; redaction."""

import hashlib
import random
import re

import pytest

from radiomap.llm import pii


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_is_the_plain_patterns():
    draw = random.Random(4)
    for alphabet in ("a@.-%+1", "0123456789 -", "0123.", "+0 ().-5", "aé@.+0123456789 -()"):
        for _ in range(1500):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(60)))
            assert pii.base_spans(text) == plain(text), text


def test_base_is_linear():
    for text in ("a" * 200_000, "a@" * 100_000, "1" * 200_000, "1." * 100_000, "1 " * 100_000, "+1 " * 60_000, "٣٤" * 50_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_field_on_unseen_rows(field):
    random_state, pii.SEED = pii.SEED, 77
    try:
        rows = pii.labelled_rows(400)
    finally:
        pii.SEED = random_state
    got = field.decode([t for t, _ in rows])
    assert sum(g == y for g, (_, y) in zip(got, rows, strict=True)) / len(rows) > 0.97


def test_field_adds_what_greed_hides(field):
    card = "4845168114407329"
    text = f"words 7536784127813050 {card} words, 1234567890123 and 2.0.1 or 12:30"
    base = [pii.base_spans(text)]
    (added,) = pii.added_spans([text], base, field)
    assert [text[s:e] for s, _, e in added if text[s:e] == card] == [card]
    assert all(text[s:e] not in ("2.0.1", "12:30") for s, _, e in added)


def test_viterbi_is_the_best_path(field):
    import itertools

    import numpy as np
    tokens = ["+1", "(017)", "555-7713"]
    emit = field.features(tokens) @ field.emit
    score = lambda ys: (sum(emit[i, y] for i, y in enumerate(ys)) + field.move[0, ys[0]] + field.move[ys[-1], 0]
                        + sum(field.move[a, b] for a, b in itertools.pairwise(ys)))
    best = max(itertools.product(range(len(pii.LABELS)), repeat=3), key=score)
    assert tuple(field.decode([tokens])[0]) == best
    assert np.isfinite(emit).all()


def test_rows_and_redaction(spark):
    rows = [(1, "mail a.b@c.de now", 17, "x"), (1, "mail a.b@c.de now", 17, "x"), (None, None, None, None), (2, "", 0, "x"),
            (3, "none here", 99, "x"), (4, "w " * 100_000 + "1.2.3.4", 200_007, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert pii.find(docs).count() == 6
    assert got[1].spans == "email:5:13" and got[1].base_sha256 == hashlib.sha256(b"email:5:13").hexdigest()
    assert got[4].n_ip == 1 and got[None].spans == "" and got[3].n_email == 0
    red = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert red[1].text == "mail [EMAIL] now" and red[1].n_chars == len(red[1].text)
    assert red[3].text == "none here" and red[3].n_chars == 99 and red[None].text is None
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs.limit(0)).count() == 0
