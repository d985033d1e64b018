"""Byte-pair encoding and decoding with a public vocabulary, by pair occurrence index.

The merges run over all distinct words of a batch at once. An index maps every
pair that the vocabulary can merge to all its positions in the batch; the
active ranks are applied in ascending order, each at all its positions, and only
the lists of the pairs next to a merge are updated. Because a merge can only give
rise to pairs of higher rank (checked when a vocabulary is loaded), each word
ends with the symbols that merging its lowest pair again and again would give.

The vocabulary file (about 2 MB, fixed) is read on the driver and broadcast. A
worker process keeps the codec and the words it has met, up to twice
``REMEMBERED`` and across tasks, so its memory is bounded by that, the new words of
``TOGETHER`` bytes of text (or of one longer text), and one Arrow batch. No text is
cut.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiomap.llm.pairs import PairTable, joined
from radiomap.llm.text import carried, named, slices

#: Words a worker has met lately; when they are more, only those of them that it meets again stay.
REMEMBERED = 150_000
#: Bytes of text whose new words are merged together.
TOGETHER = 8_000_000
#: Rows of ids handed over together.
SENT_ROWS = 256
#: White space of Unicode; ``str.split`` also splits at the four separators U+001C to U+001F.
_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = regex.compile("[\x1c-\x1f]")


def _byte_characters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself
    if it is printable Latin-1 other than space, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Codec:
    """Encoder and decoder for one vocabulary file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if (kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]
                or spec["decoder"] is not None or model["end_of_word_suffix"] is None):
            raise ValueError("not a word-end byte-level vocabulary of the supported kind")
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.lines = regex.compile(steps[0]["pattern"]["Regex"] + "|\n")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        chars = _byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + end] for c in chars], np.int32)
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens = [b""] * size
        for token, k in chain(vocab.items(), self.special.items()):
            self.tokens[k] = token.encode()
        #: Tokens and numbers, a space behind each.
        self.parts = pa.array([t + b" " for t in self.tokens], pa.binary())
        self.numbers = pa.array([b"%d " % k for k in range(size)], pa.binary())
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = np.full(size, -1)
        born[self.made] = np.arange(len(pairs))
        if (len(np.unique(self.made)) != len(pairs)
                or (np.maximum(born[self.left], born[self.right]) >= np.arange(len(pairs))).any()):
            raise ValueError("a merge of this vocabulary precedes the merge that makes its parts")
        #: The rank at which each pair merges; -1 for pairs that don't.
        self.ranks = PairTable(self.left, self.right, size, np.arange(len(pairs), dtype=np.int32))
        #: Words met lately and before, with their ids as 32-bit integers.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids per word); no word may be empty."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n, ends = len(raw), np.cumsum(sizes)  # positions fit 32 bits: the words of a piece are distinct
        sym = self.inner[raw]
        sym[ends - 1] = self.final[raw[ends - 1]]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            ranks, = self.ranks(sym[at], sym[after[at]])
            hit = np.flatnonzero(ranks >= 0)
            hit = hit[np.argsort(ranks[hit], kind="stable")]
            if not len(hit):
                return
            r = ranks[hit]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, where in zip(r[np.append(0, cut)].tolist(), np.split(at[hit], cut), strict=True):
                if k not in index:
                    index[k] = []
                    heapq.heappush(active, k)
                index[k].append(where)

        add(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            at = np.sort(np.concatenate(index.pop(r)))
            at = at[np.append(True, at[1:] != at[:-1])]
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (sym[at] == a) & (after[at] >= 0)]
            at = at[sym[after[at]] == b]
            if a == b and len(at) > 1:  # in a run of one symbol every other pair merges, from the left
                joined = after[at[:-1]] == at[1:]
                begins = np.flatnonzero(np.append(True, ~joined))
                place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
                at = at[place % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            behind = after[gone]
            sym[at] = self.made[r]
            alive[gone] = False
            after[at] = behind
            tail = behind >= 0
            before[behind[tail]] = at[tail]
            ahead = before[at]
            add(np.concatenate([ahead[ahead >= 0], at[tail]]))
        owner = np.repeat(np.arange(len(words)), sizes)[alive]
        return sym[alive], np.bincount(owner, minlength=len(words))

    def split(self, text: str) -> list[str]:
        """The white-space separated words of a text; neither the pattern nor a
        special token nor normalisation reaches over white space."""
        return [w for w in _SPACE.split(text) if w] if _ODD.search(text) else text.split()

    def _pieces(self, word: str) -> list[str | int]:
        """A word as pieces to merge (byte strings as Latin-1) and special ids."""
        out: list[str | int] = []

        def plain(part: str) -> None:
            part = unicodedata.normalize("NFC", part)
            part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
            out.extend(m for m in self.pattern.findall(part) if m)

        start = 0
        if self.specials and "<" in word:
            for m in self.specials.finditer(word):
                plain(word[start:m.start()])
                out.append(self.special[m.group()])
                start = m.end()
        plain(word[start:])
        return out

    def _together(self, words: list[str]) -> tuple[list[str], list[int]]:
        """(pieces of all words in order, pieces of each), by one pass of normalisation and
        of the pattern over all words; none may hold a special token."""
        text = unicodedata.normalize("NFC", "\n".join(words))
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        found = [m for m in self.lines.findall(text) if m]
        ends = [-1, *(k for k, m in enumerate(found) if m == "\n"), len(found)]
        return [m for m in found if m != "\n"], [b - a - 1 for a, b in zip(ends, ends[1:])]

    def learn(self, words: set[str]) -> None:
        """Make known ``words`` that are not; those not met before either are encoded all together."""
        again = self.before.keys() & words
        self.known.update(zip(again, map(self.before.__getitem__, again)))
        words = words - again
        odd = [w for w in words if "<" in w] if self.specials else []
        new = list(words.difference(odd))
        if not words:
            return
        pieces, counts = self._together(new) if new else ([], [])
        for w in odd:
            more = self._pieces(w)
            pieces.extend(more)
            counts.append(len(more))
        new += odd
        distinct = list(dict.fromkeys(pieces))
        place = np.fromiter(map(dict(zip(distinct, range(len(distinct)))).__getitem__, pieces), np.int64, len(pieces))
        plain = [p for p in distinct if isinstance(p, str)]
        flat, some = self.merge([p.encode() for p in plain]) if plain else (np.empty(0, np.int32), np.empty(0, np.int64))
        sizes = np.ones(len(distinct), np.int64)
        text = np.array([isinstance(p, str) for p in distinct], bool)
        sizes[text] = some
        starts = np.cumsum(sizes) - sizes
        ids = np.array([p if isinstance(p, int) else -1 for p in distinct], np.int32).repeat(sizes)
        ids[np.repeat(text, sizes)] = flat
        wide = sizes[place]
        raw = ids[np.repeat(starts[place] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())].astype(np.int32).tobytes()
        ends = (4 * np.append(0, np.cumsum(wide))[np.cumsum(counts)]).tolist()
        self.known.update(zip(new, [raw[i:j] for i, j in zip([0, *ends], ends)]))

    def arrays(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop == start or (stop < len(texts) and size + len(texts[stop]) <= TOGETHER):
                size += len(texts[stop])
                stop += 1
            if len(self.known) > REMEMBERED:
                self.known, self.before = {}, self.known
            new: set[str] = set()
            for t in texts[start:stop]:
                new.update(self.split(t))
            self.learn(new.difference(self.known))
            for t in texts[start:stop]:
                yield np.frombuffer(b"".join(map(self.known.__getitem__, self.split(t))), np.int32)
            start = stop

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text in order, as lists."""
        return (ids.tolist() for ids in self.arrays(texts))

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """The text (UTF-8) of ids; without a decoder, tokens are joined by a space."""
        return joined(self.parts, np.asarray(ids, np.int32))[:-1]


_CODECS: dict[str, Codec] = {}


def codec_of(source: str) -> Codec:
    """The codec of a vocabulary's JSON text; a worker process builds it once and keeps what it has learnt."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(source)
    return _CODECS[key]


def _codec_for(docs: DataFrame, tokenizer: str):
    """The vocabulary as a broadcast, which each worker turns into a codec once."""
    with open(tokenizer, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def _coded(codec: Codec, batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]:
    """Runs of ``SENT_ROWS`` rows of a batch at most, and the ids of their texts."""
    for some in slices(batch, column, TOGETHER):
        arrays = codec.arrays(_texts(some.column(column)))
        for start in range(0, some.num_rows, SENT_ROWS):
            part = some.slice(start, SENT_ROWS)
            yield part, islice(arrays, part.num_rows)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", digest: str | None = None) -> DataFrame:
    """``docs`` with ``ids array<int>`` in place of its text, and, if a name for it
    is given, the SHA-256 of the text decoded from the ids in the column ``digest``.

    A null or empty text, or one of white space only, has no ids. Other columns
    pass through unchanged, repeated rows, null keys and names with dots included; a
    column of ``docs`` that is called ids or like ``digest`` is replaced."""
    shared = _codec_for(docs, tokenizer)
    source, names, schema = carried(docs, F.col(named(text)).cast("string"), text, "ids", digest)
    schema += "ids array<int>" + (", digest string" if digest else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for b in batches:
            for part, coded in _coded(codec, b, len(names)):
                lists = list(coded)
                ends = np.cumsum([0, *map(len, lists)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))
                columns, fields = [*part.columns[:len(names)], ids], [*part.schema.names[:-1], "ids"]
                if digest:
                    columns.append(pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in lists], pa.string()))
                    fields.append("digest")
                yield pa.RecordBatch.from_arrays(columns, fields)

    return source.mapInArrow(run, schema).toDF(*names, "ids", *([digest] if digest else []))


def decode(coded: DataFrame, tokenizer: str) -> DataFrame:
    """``coded`` with the decoded ``text`` in place of ``ids`` (null: empty)."""
    shared = _codec_for(coded, tokenizer)
    source, names, schema = carried(coded, F.col("ids"), "ids", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for b in batches:
            for start in range(0, b.num_rows, SENT_ROWS):
                part = b.slice(start, SENT_ROWS)
                texts = pa.array([codec.decode(x or []).decode() for x in part.column(len(names)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], texts], [*part.schema.names[:-1], "text"])

    return source.mapInArrow(run, schema + "text string").toDF(*names, "text")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and
    decoded again from its ids; cases as in ``encode``."""
    shared = _codec_for(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for b in batches:
            for part, coded in _coded(codec, b, 1):
                sizes, ids_hash, text_hash = [], [], []
                for ids in coded:
                    sizes.append(len(ids))
                    ids_hash.append(hashlib.sha256(joined(codec.numbers, ids)[:-1]).hexdigest())
                    text_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
