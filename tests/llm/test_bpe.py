"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from radiomap.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(3)
    out = ["", "  ", "aaaa aaaaaaaaa !!!!!!! <|endoftext|>x<|startoftext|>  y's we'll 'tis I'D ΣΑΣ İ \x1c\x1d ½² 一二 १२", "<|endoftext|" * 3]
    out += ["".join(draw.choice("aAbBéÉ ßΣσ'`<|>\n\t\x1c\x1f\xa0́१½中!?.,0123\U0001F600ſtsedlrvm") for _ in range(draw.randrange(80)))
            for _ in range(800)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return out + [r.text for r in docs] + ["word " * 100_000]


def test_same_as_the_library(library, texts):
    codec = bpe.Codec(open(PATH, encoding="utf-8").read())
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:80]
        assert codec.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_rows(spark, library, texts):
    rows = [(None, None, None)] + [(k % 50, t, "c") for k, t in enumerate(texts[:200])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digests(frame, PATH).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(frame, PATH), PATH)
    assert back.columns == ["doc_id", "text"] and back.count() == len(rows)
    assert bpe.digests(frame.limit(0), PATH).count() == 0


def test_memory_of_words_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    codec = bpe.Codec(open(PATH, encoding="utf-8").read())
    for text in ("a b c d e", "f g h", "a b"):
        assert next(codec.encode([text])) == library.encode(text, add_special_tokens=False).ids
