"""SentencePiece encoding and decoding (BPE with byte fallback) by vectorised merge rounds.

A text is normalised (a space becomes the word mark, and one is put in front)
and cut wherever no piece of the vocabulary holds the two code points side by
side: no merge can reach over such a place, so the parts between are independent
"words". All distinct words of a stretch of text not met before are laid out as
one flat numpy array of symbols and merged together in rounds. In a round

* the rank of each neighbouring pair (that of the piece which the two make
  together, the best score being the least rank) is at hand,
* a segmented minimum gives each word's least rank,
* every word merges its pairs of that rank from the left, up to the first merge
  that gives rise to a pair of better or equal rank, which has to come next (the
  ranks for which that can be are found when a model is loaded),
* words in which no pair is left are written out, and the arrays are compacted,

until no word is left. Code points without a piece become the ids of their UTF-8
bytes.

The model file (about half a MB, fixed) is read on the driver and broadcast. A
worker process keeps the codec and the words it has met, up to twice ``REMEMBERED``
and across tasks, so its memory is bounded by that, the new words of ``TOGETHER``
code points (or of one longer text), and one Arrow batch. No text is cut.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiomap.llm.pairs import PairTable, joined
from radiomap.llm.text import carried, named

#: Words a worker has met lately; when they are more, only those of them that it meets again stay.
REMEMBERED = 200_000
#: Code points of text whose new words are merged together, and rows handed over at a time.
TOGETHER, SENT_ROWS = 1_000_000, 256
MARK = "▁"
#: Fixed values of the file format: piece types, the BPE model type, the text of an unknown id.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_TYPE = 2
UNKNOWN_TEXT = " ⁇ "
_NEVER = np.int32(2**31 - 1)
_WORD = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")
_LEAD = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.int64)

codecs.register_error("piece-bytes", lambda e: ("�", e.start + 1))


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 2, 5):
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, raw[at:at + size]
            at += size
        else:
            raise ValueError("not a SentencePiece model")


class Codec:
    """Encoder and decoder for one model file (its bytes)."""

    def __init__(self, source: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(source):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        kinds = {k for _, _, k in pieces}
        if (trainer.get(3) != BPE_TYPE or not trainer.get(35) or trainer.get(24) or normalizer.get(2) or not normalizer.get(3, 1)
                or normalizer.get(4, 1) or not normalizer.get(5, 1) or kinds & {USER_DEFINED, UNUSED}):
            raise ValueError("not a byte-fallback BPE model with the identity normaliser and a dummy prefix")
        self.size = len(pieces)
        self.end = next(i for i, (p, _, k) in enumerate(pieces) if k == CONTROL and p == "</s>")
        self.byte = np.zeros(256, np.int32)
        self.tokens = [b""] * self.size
        self.marked = [False] * self.size
        normal: dict[str, int] = {}
        for i, (p, _, k) in enumerate(pieces):
            if k == NORMAL:
                normal[p] = i
                self.tokens[i] = p.replace(MARK, " ").encode()
                self.marked[i] = p.startswith(MARK)
            elif k == BYTE:
                self.byte[int(p[3:5], 16)] = i
                self.tokens[i] = bytes([int(p[3:5], 16)])
            elif k == UNKNOWN:
                self.tokens[i] = UNKNOWN_TEXT.encode()
        self.numbers = pa.array([b"%d " % i for i in range(self.size)], pa.binary())
        self.parts = pa.array(self.tokens, pa.binary())
        scores, place = np.unique([-pieces[i][1] for i in normal.values()], return_inverse=True)
        rank = dict(zip(normal, place.tolist(), strict=True))

        # Symbols are pieces and, beyond them, code points that only occur inside pieces.
        symbol = dict(normal)
        for c in sorted({c for p in normal for c in p} - normal.keys()):
            symbol[c] = self.size + len(symbol) - len(normal)
        self.wide = self.size + len(symbol) - len(normal)
        self.of_code = np.full(0x110000, -1, np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                self.of_code[ord(p)] = i
        beside, made = set(), {}
        early = np.zeros(len(scores) + 1, bool)
        for p, i in normal.items():
            beside.update(zip(p, p[1:]))
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in symbol and b in symbol:
                    made[symbol[a] * self.wide + symbol[b]] = (rank[p], i)
                    for part in (a, b):
                        if rank.get(part, -1) >= rank[p]:
                            early[rank[part]] = True
        #: Ranks whose piece can be part of one of better or equal rank.
        self.early = early
        heads, tails = ([*dict.fromkeys(p[k] for p in sorted(beside))] for k in (0, 1))
        self.head, self.tail = np.zeros(0x110000, np.int16), np.zeros(0x110000, np.int16)
        self.head[[ord(c) for c in heads]] = np.arange(1, len(heads) + 1)
        self.tail[[ord(c) for c in tails]] = np.arange(1, len(tails) + 1)
        #: Whether some piece holds two code points side by side, by their places among first and second ones.
        self.beside = np.zeros((len(heads) + 1, len(tails) + 1), bool)
        for a, b in beside:
            self.beside[self.head[ord(a)], self.tail[ord(b)]] = True
        pairs, values = np.array([*made], np.int64), np.array([*made.values()], np.int32).reshape(-1, 2)
        self.pairs = PairTable(pairs // self.wide, pairs % self.wide, self.wide, values[:, 0], values[:, 1], missing=-1)
        #: Words met lately and before, with their ids as 32-bit integers.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece made) of each pair of symbols; never for those that make none."""
        rank, made = self.pairs(a, b)
        return np.where(made < 0, _NEVER, rank), made

    def cut(self, codes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """True where a symbol begins a part of its own: the first of a word (by
        ``words``), and those that no piece holds behind the code point before."""
        joined = self.beside[self.head[codes[:-1]], self.tail[codes[1:]]] & (words[1:] == words[:-1])
        return np.append(True, ~joined)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids per word); words are normalised, none is empty."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), list(map(len, words)))
        done = self.of_code[codes]
        left = np.ones(len(codes), bool)
        seg = np.cumsum(self.cut(codes, owner), dtype=np.int32)
        pos, sym = np.arange(len(codes), dtype=np.int32), done.copy()
        rank, made = np.full(len(codes), _NEVER), np.full(len(codes), -1, np.int32)
        inner = np.flatnonzero(seg[1:] == seg[:-1])
        rank[inner], made[inner] = self._pairs(sym[inner], sym[inner + 1])
        while len(pos):
            starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            sizes = np.diff(np.append(starts, len(pos)))
            least = np.minimum.reduceat(rank, starts)
            over = np.repeat(least == _NEVER, sizes)
            if over.any():  # words without a pair leave
                done[pos[over]] = sym[over]
                pos, sym, seg, rank, made = (x[~over] for x in (pos, sym, seg, rank, made))
                continue
            hit = rank == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (seg[at[1:]] != seg[at[:-1]])))
            turn = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[turn % 2 == 0]
            some = self.early[rank[at]]
            if some.any():
                at = np.sort(np.append(at[~some], self._up_to_stop(at[some], sym, seg, rank, made)))
            sym[at] = made[at]
            stays = np.ones(len(pos), bool)
            stays[at + 1] = False
            left[pos[at + 1]] = False
            at -= np.searchsorted(at, at)  # a symbol has gone for each merge before it
            pos, sym, seg, rank, made = (x[stays] for x in (pos, sym, seg, rank, made))
            near = np.append(at, at[at > 0] - 1)
            inner = near[near + 1 < len(pos)]
            inner = inner[seg[inner] == seg[inner + 1]]
            rank[near], made[near] = _NEVER, -1
            rank[inner], made[inner] = self._pairs(sym[inner], sym[inner + 1])
        return self._ids(done[left], codes[left], owner[left], len(words))

    def _up_to_stop(self, at: np.ndarray, sym: np.ndarray, seg: np.ndarray, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Of the merges ``at`` (in order, none overlaps another): in each word those up to
        the first that gives rise to a pair which must be merged before the next."""
        new, last = made[at], len(sym) - 1
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, last)
        left = sym[before]
        meets = np.flatnonzero(at[1:] == at[:-1] + 2) + 1
        left[meets] = new[meets - 1]
        sooner = ((seg[before] == seg[at]) & (before < at) & (self._pairs(left, new)[0] <= rank[at])) \
            | ((seg[after] == seg[at]) & (after == at + 2) & (self._pairs(new, sym[after])[0] <= rank[at]))
        word = np.flatnonzero(np.append(True, seg[at[1:]] != seg[at[:-1]]))
        stops = np.cumsum(sooner) - sooner
        return at[stops == np.repeat(stops[word], np.diff(np.append(word, len(at))))]

    def _ids(self, sym: np.ndarray, codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids: a piece is one, any other code point its UTF-8 bytes'."""
        odd = (sym < 0) | (sym >= self.size)
        size = np.where(odd, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), 1)
        ids = np.repeat(sym, size)
        if odd.any():
            wide, code = size[odd], codes[odd]
            places = np.repeat(np.cumsum(size)[odd] - wide, wide)
            nth = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
            wide, code = np.repeat(wide, wide), np.repeat(code, wide)
            bits = code >> (6 * (wide - 1 - nth))
            ids[places + nth] = self.byte[np.where(nth == 0, np.where(wide == 1, bits, _LEAD[wide] | bits), 0x80 | (bits & 63))]
        return ids, np.bincount(owner, size, n).astype(np.int64)

    def split(self, text: str) -> list[str]:
        """The normalised text as words whose ends no piece reaches over: a word begins
        with a run of marks, of which the first is left out here, or with a line's end."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text:
            return [w[1:] if w[0] == MARK else w for w in _WORD.findall(MARK + text.replace(" ", MARK))]
        return text.replace("\n", " \n").split(" ")

    def learn(self, words: set[str]) -> None:
        """Make known ``words`` that are not; those not met before either are encoded all together."""
        again = self.before.keys() & words
        self.known.update(zip(again, map(self.before.__getitem__, again)))
        new = list(words - again)
        if not new:
            return
        flat, sizes = self.merge([w if w[:1] == "\n" else MARK + w for w in new])
        raw = flat.astype(np.int32).tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        self.known.update(zip(new, [raw[i:j] for i, j in zip([0, *ends], ends)]))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text in order, the end id last."""
        start, end = 0, np.int32(self.end).tobytes()
        while start < len(texts):
            stop, size = start, 0
            while stop == start or (stop < len(texts) and size + len(texts[stop]) <= TOGETHER):
                size += len(texts[stop])
                stop += 1
            if len(self.known) > REMEMBERED:
                self.known, self.before = {}, self.known
            split = [self.split(t) for t in texts[start:stop]]
            self.learn(set(chain.from_iterable(split)).difference(self.known))
            for words in split:
                yield np.frombuffer(b"".join(map(self.known.__getitem__, words)) + end, np.int32)
            start = stop

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes that are no UTF-8 are replaced one by one, and the
        mark that encoding put in front is taken away."""
        raw = joined(self.parts, ids)
        if raw[:1] == b" " and self.marked[next(i for i in ids.tolist() if self.tokens[i])]:
            raw = raw[1:]
        return raw.decode("utf-8", "piece-bytes")


_CODECS: dict[str, Codec] = {}


def codec_of(source: bytes) -> Codec:
    """The codec of a model's bytes; a worker process builds it once and keeps what it has learnt."""
    key = hashlib.sha256(source).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(source)
    return _CODECS[key]


def _shared(frame: DataFrame, model: str):
    with open(model, "rb") as f:
        return frame.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>`` (the end id last) in place of its text.

    A null or empty text has the end id alone. Other columns pass through
    unchanged, repeated rows, null keys and names with dots included; a column
    that is called ids is replaced. An empty table gives an empty table."""
    shared = _shared(docs, model)
    source, names, schema = carried(docs, F.col(named(text)).cast("string"), text, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for b in batches:
            for start in range(0, b.num_rows, SENT_ROWS):
                part = b.slice(start, SENT_ROWS)
                lists = list(codec.encode([t or "" for t in part.column(len(names)).to_pylist()]))
                ends = np.cumsum([0, *map(len, lists)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], ids], [*part.schema.names[:-1], "ids"])

    return source.mapInArrow(run, schema + "ids array<int>").toDF(*names, "ids")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """``coded`` with the decoded ``text`` in place of ``ids`` (null: empty)."""
    shared = _shared(coded, model)
    source, names, schema = carried(coded, F.col("ids"), "ids", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for b in batches:
            for start in range(0, b.num_rows, SENT_ROWS):
                part = b.slice(start, SENT_ROWS)
                texts = pa.array([codec.decode(np.array(x or [], np.int32)) for x in part.column(len(names)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], texts], [*part.schema.names[:-1], "text"])

    return source.mapInArrow(run, schema + "text string").toDF(*names, "text")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: its text encoded,
    and decoded again from the ids; cases as in ``encode``."""
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for b in batches:
            for start in range(0, b.num_rows, SENT_ROWS):
                part = b.slice(start, SENT_ROWS)
                sizes, ids_hash, text_hash = [], [], []
                for ids in codec.encode([t or "" for t in part.column(1).to_pylist()]):
                    sizes.append(len(ids))
                    ids_hash.append(hashlib.sha256(joined(codec.numbers, ids)[:-1]).hexdigest())
                    text_hash.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
