"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from radiomap.llm import piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return piece_bpe.Codec(f.read())


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(3)
    out = ["", " ", "  ", "a  b", " a", "\n", "\n\n x", "a \n b\n", "<s></s><0x0A>", "▁▁ a▁b", "日本語テキスト" * 50, "\0\x01\x7f", "a" * 5000, "ab" * 3000,
           " " * 100, "é̂ᄀ각", "�", "\U0001F600" * 10, "\U0010ffff"]
    out += ["".join(draw.choice("aAbBéÉ ßΣσ'`<|>\n\t\x1c\xa0́१½中!?.,0123\U0001F600tsedlrvm▁  ") for _ in range(draw.randrange(80))) for _ in range(500)]
    out += ["".join(draw.choice("etaoinshrdlu ") for _ in range(draw.randrange(400))) for _ in range(500)]
    out += ["".join(chr(draw.choice([draw.randrange(32, 0xd000), draw.randrange(0x1f300, 0x1f700)])) for _ in range(draw.randrange(60))) for _ in range(200)]
    out += ["".join(draw.choice("etaoin") for _ in range(30_000)), "word " * 100_000]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return out + [r.text for r in docs]


def test_same_as_the_library(library, codec, texts):
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_eos=True), text[:80]
        assert codec.decode(ids) == library.decode(ids.tolist())


def test_any_ids_decode(library, codec):
    draw = random.Random(4)
    for _ in range(800):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(259), draw.randrange(259, 2000)]) for _ in range(draw.randrange(12))]
        assert codec.decode(np.array(ids, np.int32)) == library.decode(ids), ids


def test_words_are_forgotten_and_met_again(library, codec, texts, monkeypatch):
    monkeypatch.setattr(piece_bpe, "REMEMBERED", 20)
    monkeypatch.setattr(piece_bpe, "TOGETHER", 300)
    for text, ids in zip(texts[:400], codec.encode(texts[:400]), strict=True):
        assert ids.tolist() == library.encode(text, add_eos=True)


def test_rows(spark, library, texts):
    rows = [(None, None, None, 1)] + [(k % 50, t, "c", k) for k, t in enumerate(texts[:300])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, `a.b` int")
    got = sorted(map(tuple, piece_bpe.digests(frame, PATH).collect()), key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    coded = [(i, library.encode(t or "", add_eos=True)) for i, t, *_ in rows]
    assert got == sorted(((i, len(x), sha(" ".join(map(str, x))), sha(library.decode(x))) for i, x in coded), key=str)
    ids = piece_bpe.encode(frame, PATH)
    assert ids.columns == ["doc_id", "a.b", "ids"]
    back = piece_bpe.decode(ids, PATH)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, n, library.decode(x)) for (i, x), (*_, n) in zip(coded, rows)), key=str)
    assert piece_bpe.digests(frame.limit(0), PATH).count() == 0 and piece_bpe.decode(ids.limit(0), PATH).count() == 0


def message(number, kind, body):
    tag = number << 3 | kind
    return (bytes([tag]) if tag < 128 else bytes([tag & 127 | 128, tag >> 7])) + (bytes([len(body)]) + body if kind == 2 else body)


def plain_merges(text, rank):
    """The least rank anywhere, leftmost first, until no pair makes a piece."""
    parts = list(text)
    while True:
        found = [(rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
        if not found:
            return parts
        k = min(found)[1]
        parts[k:k + 2] = ["".join(parts[k:k + 2])]


@pytest.mark.parametrize("seed", range(6))
def test_pieces_that_must_come_before_others(seed):
    """Vocabularies in which a piece may be better than its parts, ranks tied at times."""
    draw = random.Random(seed)
    names = {"".join(draw.choice("ab▁c") for _ in range(draw.randrange(2, 6))) for _ in range(40)} | set("abc▁")
    names = [n for n in sorted(names) if not any(x != "▁" and y == "▁" for x, y in zip(n, n[1:]))]
    pieces = [("<unk>", 0, 2), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256)]
    pieces += [(n, -draw.randrange(25) if len(n) > 1 else -99, 1) for n in names]
    raw = b"".join(message(1, 2, message(1, 2, p.encode()) + message(2, 5, struct.pack("<f", s)) + message(3, 0, bytes([k]))) for p, s, k in pieces)
    raw += message(2, 2, message(3, 0, b"\2") + message(35, 0, b"\1")) + message(3, 2, message(3, 0, b"\1") + message(4, 0, b"\0"))
    codec = piece_bpe.Codec(raw)
    ids = {p: k for k, (p, _, kind) in enumerate(pieces) if kind == 1}
    rank = {p: -s for p, s, kind in pieces if kind == 1}
    for _ in range(300):
        text = "".join(draw.choice("ab c") for _ in range(draw.randrange(1, 40)))
        want = [ids[p] for p in plain_merges("▁" + text.replace(" ", "▁"), rank)]
        assert next(codec.encode([text])).tolist() == [*want, 1], text


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        piece_bpe.Codec(message(1, 2, message(1, 2, b"x")) + message(2, 2, message(3, 0, b"\1")))
