"""Language-model scores from a weighted backoff automaton of smoothed trigrams.

Model. Modified Kneser-Ney of order three, interpolated, trained on the rows that
are not held out; a text begins with two marks and ends with one. As an automaton:
the root state has an arc for every word with the weight of the lowest order. Every
word after which training goes on is a state, with an arc for each bigram seen from
it and a failure arc to the root; every such pair of words is a state, with an arc
for each trigram and a failure arc to the state of its last word. A failure arc
weighs what smoothing leaves to the shorter context. A text is read once from left
to right: the state is carried, failure arcs are followed until one has an arc for
the word, and the weights add up.

Scale. The model grows with the corpus and is never held by one process. The
texts are packed once into blocks of about ``BLOCK_BYTES`` (word ids local to
the block plus the 64-bit keys of its words). Four rounds follow, each by
Spark's grouping of packed rows:

1. every block asks for the training counts of its distinct words and trigrams. A
   request is cut by key range; a range adds up what it is sent and answers in the
   order asked, so no keys travel back. One asking block is named the owner of each
   trigram;
2. every block adds up, for the trigrams it owns, the continuation counts of their
   last pair and the followers of their first pair, and asks for these by pair;
3. the same again from the owned pairs to their words;
4. every block builds the part of the automaton that its texts can reach and
   walks it.

A request has at most ``FAN`` rows. Where the corpus needs more ranges than that,
requests go through levels of relays: a relay joins the requests of up to about
``FAN`` blocks for one range, passes them on to the ranges inside it, and hands the
answers back. So rows grow with the blocks, not with blocks times ranges.

No list is kept by word, so a very frequent word is a row for each block at most.
Keys are 64-bit hashes: with v distinct words, pairs or trigrams two share a key
with odds of about v^2 / 2^65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiomap.llm.text import mix, release, utf8, word_keys
from radiomap.session import materialize

#: Text in one block.
BLOCK_BYTES = 12 << 20
#: Tokens for which one more key range is laid out.
BUCKET_TOKENS = 2_000_000
#: Rows of a request at most, and about as many requests for a relay.
FAN = 512
#: Tokens that the walk takes out of arrays at a time.
STRIDE = 1 << 16
END, BEGIN = np.uint64(0), np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
WORDS, TRIGRAMS, PAIRS, HEADS = 0, 1, 2, 3

_BLOCK_SCHEMA = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, words binary, ids binary"
_ASK_SCHEMA = "kind int, lane long, node long, keys binary, counts binary"
_ANSWER_SCHEMA = "node long, kind int, lane long, totals binary, stats array<long>"


def _pack(x: np.ndarray) -> bytes:
    """An integer array as its byte planes, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, held) as blocks; numbers are unique by partition."""
    number = TaskContext.get().partitionId() << 32
    ids: list = []
    held: list = []
    texts: list[bytes] = []

    def block() -> pa.RecordBatch:
        keys, counts = word_keys(texts)
        sizes = counts + 1
        stream = np.full(int(sizes.sum()), END)
        inside = np.ones(len(stream), bool)
        inside[np.cumsum(sizes) - 1] = False
        stream[inside] = keys
        words, local, n = np.unique(stream, return_inverse=True, return_counts=True)
        often = np.argsort(-n, kind="stable")
        place = np.empty(len(words), np.uint32)
        place[often] = np.arange(len(words), dtype=np.uint32)
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
             pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([words[often].tobytes()], pa.binary()),
             pa.array([_pack(place[local])], pa.binary())],
            ["block", "doc_ids", "held", "sizes", "words", "ids"])

    full = 0
    for batch in batches:
        for i, t, h in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            if texts and full + len(t) > BLOCK_BYTES:
                yield block()
                ids, held, texts, full, number = [], [], [], 0, number + 1
            ids.append(i)
            held.append(h)
            texts.append(t)
            full += len(t)
    if texts:
        yield block()


class _Types:
    """The distinct keys of a stream, sorted: training counts, one position of each."""

    def __init__(self, stream: np.ndarray, trains: np.ndarray):
        order = np.argsort(stream)
        ranked = stream[order]
        fresh = np.append(True, ranked[1:] != ranked[:-1])
        first = np.flatnonzero(fresh)
        self.keys, self.at = ranked[first], order[first]
        self.counts = np.add.reduceat(trains[order], first, dtype=np.int64)
        self.of = np.empty(len(order), np.int32)
        self.of[order] = np.cumsum(fresh) - 1


class _Block:
    """One block: words (begin first), the token stream, its pairs and trigrams.

    A place behind the stream stands for the two marks before a text's first word."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.doc_ids = row["doc_ids"]
        self.held = np.array(row["held"], bool)
        self.sizes = np.array(row["sizes"], np.int64)
        self.words = np.append(BEGIN, np.frombuffer(row["words"], np.uint64))
        self.ids = np.append(_unpack(row["ids"], np.uint32).astype(np.int32) + 1, np.int32(0))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.last = np.arange(-1, len(self.ids) - 1)  # the place before each token
        self.last[self.starts] = len(self.ids) - 1
        self.before = self.ids[self.last]
        self.before[-1] = 0
        self.trains = np.append(np.repeat(~self.held, self.sizes), False)
        self.sorted_words = np.argsort(self.words)

    def word_counts(self) -> tuple[np.ndarray, np.ndarray]:
        n = np.bincount(self.ids[self.trains], minlength=len(self.words))
        return self.words[self.sorted_words], n[self.sorted_words]

    def types(self, pairs: bool = True, trigrams: bool = True) -> None:
        keys = mix(self.words[self.before] * _STEP + self.words[self.ids])
        if pairs:
            self.pairs = _Types(keys, self.trains)
        if trigrams:
            self.trigrams = _Types(mix(keys[self.last[:-1]] * _STEP + self.words[self.ids[:-1]]), self.trains[:-1])


def _ask(kind: int, node: int, parent: int, fan: int, ranges: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
    """Sorted keys of the range ``parent`` with a row of counts each, cut into the
    ``fan`` ranges that lie inside it, of ``ranges`` in all."""
    edges = np.array([-(-((parent * fan + k) << 64) // ranges) for k in range(1, fan)], np.uint64)
    cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    for b in range(fan):
        lo, hi = cut[b], cut[b + 1]
        if hi > lo:
            yield {"kind": kind, "lane": parent * fan + b, "node": node,
                   "keys": _pack(np.diff(keys[lo:hi], prepend=np.uint64(0))), "counts": _pack(counts[lo:hi].astype(np.int64))}


_ASK = pa.schema([("kind", pa.int32()), ("lane", pa.int64()), ("node", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("node", pa.int64()), ("kind", pa.int32()), ("lane", pa.int64()), ("totals", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _wide(kind: int) -> int:
    return 5 if kind in (PAIRS, HEADS) else 1


class _Requests:
    """The requests for one key range joined: distinct keys with summed counts."""

    def __init__(self, table: pa.Table):
        rows = sorted(table.select(["kind", "lane", "node", "keys", "counts"]).to_pylist(), key=lambda r: r["node"])
        self.kind, self.lane, self.nodes = rows[0]["kind"], rows[0]["lane"], [r["node"] for r in rows]
        lists = [np.cumsum(_unpack(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
        self.sizes = [len(x) for x in lists]
        keys = np.concatenate(lists)
        counts = np.concatenate([_unpack(r["counts"], np.int64) for r in rows]).reshape(-1, _wide(self.kind))
        order = np.argsort(keys, kind="stable")
        fresh = np.append(True, keys[order][1:] != keys[order][:-1])
        first = np.flatnonzero(fresh)
        self.keys, self.sums = keys[order[first]], np.add.reduceat(counts[order], first, axis=0)
        self.first = order[first]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(fresh) - 1

    def answers(self, codes: np.ndarray) -> list[dict]:
        """``codes``, one row a distinct key, in the order of every request. The first
        column is a total doubled, plus one for an owner; of several requests for a key
        that of the least number keeps the mark."""
        out = codes[self.of]
        mark = out[self.first, 0] % 2
        out[:, 0] -= out[:, 0] % 2
        out[self.first, 0] += mark
        rows, at = [], 0
        for node, n in zip(self.nodes, self.sizes, strict=True):
            rows.append({"node": node, "kind": self.kind, "lane": self.lane, "totals": _pack(out[at:at + n]), "stats": None})
            at += n
        return rows


def _answer(table: pa.Table) -> pa.Table:
    """One range: totals for every request, and statistics of the first column: its
    sum, how many are 1, 2, 3 and 4, and how many are above 0."""
    asked = _Requests(table)
    n = asked.sums[:, 0]
    stats = [int(n.sum()), *(int((n == k).sum()) for k in (1, 2, 3, 4)), int((n > 0).sum())]
    codes = asked.sums.copy()
    codes[:, 0] = codes[:, 0] * 2 + 1
    rows = [{"node": None, "kind": asked.kind, "lane": asked.lane, "totals": None, "stats": stats}, *asked.answers(codes)]
    release()
    return pa.Table.from_pylist(rows, _ANSWER)


def _exchange(asks: DataFrame, fan: int, levels: int, nodes: int, level: int = 1) -> tuple[DataFrame, DataFrame]:
    """(answers to ``nodes`` askers, statistics of the ranges)."""
    if level == levels:
        out = materialize(asks.groupBy("kind", "lane").applyInArrow(_answer, _ANSWER_SCHEMA), "lm-totals")
        return out.where("node is not null").drop("stats"), out.where("node is null")
    teams = math.ceil(nodes / fan)
    held = materialize(asks.withColumn("team", F.pmod(F.xxhash64("node"), F.lit(teams))), "lm-asks")

    def relay(table: pa.Table) -> pa.Table:
        asked = _Requests(table)
        rows = list(_ask(asked.kind, table["team"][0].as_py(), asked.lane, fan, fan ** (level + 1), asked.keys, asked.sums))
        release()
        return pa.Table.from_pylist(rows, _ASK)

    def hand_back(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = _Requests(left)
        rows = asked.answers(_totals(right, asked.kind))
        release()
        return pa.Table.from_pylist(rows, _ANSWER)

    got, stats = _exchange(held.groupBy("kind", "lane", "team").applyInArrow(relay, _ASK_SCHEMA), fan, levels, teams, level + 1)
    got = got.withColumn("parent", F.expr(f"lane div {fan}")).withColumnRenamed("node", "team")
    back = held.groupBy("kind", "lane", "team").cogroup(got.groupBy("kind", "parent", "team"))
    return materialize(back.applyInArrow(hand_back, _ANSWER_SCHEMA).drop("stats"), "lm-back"), stats


def _totals(table: pa.Table, kind: int) -> np.ndarray:
    """An asker's answers of one kind, in the order of its sorted keys."""
    rows = sorted((r for r in table.select(["kind", "lane", "totals"]).to_pylist() if r["kind"] == kind), key=lambda r: r["lane"])
    return np.concatenate([_unpack(r["totals"], np.int64) for r in rows]).reshape(-1, _wide(kind))


def _sums(tails: np.ndarray, heads: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """From owned types seen n times: by tail the types, by head those seen once,
    twice and more often, and n in all."""
    return np.stack([np.bincount(tails, minlength=size)]
                    + [np.bincount(heads[hit], minlength=size) for hit in (n == 1, n == 2, n > 2)]
                    + [np.bincount(heads, n, minlength=size).astype(np.int64)], axis=1)


def _owned(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Types that this block owns and that training has seen, and how often."""
    own = np.flatnonzero((codes % 2 == 1) & (codes > 1))
    return own, codes[own] // 2


def _pair_sums(block: _Block, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    block.types()
    own, n = _owned(_totals(answers, TRIGRAMS)[:, 0])
    at = block.trigrams.at[own]
    return block.pairs.keys, _sums(block.pairs.of[at], block.pairs.of[block.last[at]], n, len(block.pairs.keys))


def _head_sums(block: _Block, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    block.types(trigrams=False)
    own, n = _owned(_totals(answers, PAIRS)[:, 0])
    at = block.pairs.at[own]
    sums = _sums(block.ids[at], block.before[at], n, len(block.words))
    return block.words[block.sorted_words], sums[block.sorted_words]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken from n-grams seen 0, 1, 2 and more times (modified Kneser-Ney
    estimates, kept between 0.1 and 1, 2 and 3, so that every failure arc has a weight;
    0.5 where a count is 0)."""
    if not (n1 and n2):
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return np.array([0.0, *(min(max(x, 0.1), k) for k, x in zip((1, 2, 3), d, strict=True))])


class Automaton:
    """The states and arcs that one block can reach.

    ``root[w]``: weight of the root's arc for word w. ``fail1[u]``, ``fail2[k]``:
    weights of the failure arcs of the states of word u and of pair k; ``is1``, ``is2``:
    whether there are such states. ``arc2[k]``, ``arc3[k]``: weight of the arc of pair
    or trigram type k, nan if its context's state has none for it."""

    def __init__(self, block: _Block, answers: pa.Table, model: dict):
        order = block.sorted_words
        count, heads = np.empty(len(order), np.int64), np.empty((len(order), 5), np.int64)
        count[order] = _totals(answers, WORDS)[:, 0] // 2
        heads[order] = _totals(answers, HEADS)
        heads[:, 0] //= 2
        pairs = _totals(answers, PAIRS)
        pairs[:, 0] //= 2
        n = _totals(answers, TRIGRAMS)[:, 0] // 2
        self.count, half = count, 0.5 * (model["vocabulary"] + 1)
        d2, d3 = model["discounts2"], model["discounts3"]
        low = (heads[:, 0] + 0.5) / (model["types"] + half)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = lambda x, d: np.where(x[:, 4] > 0, x[:, 1:4] @ d[1:] / np.maximum(x[:, 4], 1), 1.0)
            mass1, mass2 = left(heads, d2), left(pairs, d3)
            u, w = block.before[block.pairs.at], block.ids[block.pairs.at]
            seen = (pairs[:, 0] - d2[np.minimum(pairs[:, 0], 3)]) / np.maximum(heads[u, 4], 1) + mass1[u] * low[w]
            self.arc2 = np.where(pairs[:, 0] > 0, np.log10(seen), np.nan)
            at = block.trigrams.at
            context, ending = block.pairs.of[block.last[at]], block.pairs.of[at]
            higher = (n - d3[np.minimum(n, 3)]) / np.maximum(pairs[context, 4], 1) + mass2[context] * seen[ending]
            self.arc3 = np.where(n > 0, np.log10(higher), np.nan)
            self.root, self.fail1, self.fail2 = np.log10(low), np.log10(mass1), np.log10(mass2)
            self.base = np.log10((count + 0.5) / (model["tokens"] + half))
        self.is1, self.is2 = heads[:, 4] > 0, pairs[:, 4] > 0

    def walk(self, block: _Block) -> np.ndarray:
        """The weight of every step of the traversal. The state is carried by how many
        words of the history it holds (0: root); which ones, the place in the stream says.

        What a word weighs from each of the three states, failure arcs followed, is laid
        out for a stretch of the stream; the walk takes the one of the state it is in."""
        size = len(block.ids) - 1
        out, state = np.empty(size), 0
        fresh = np.zeros(size, bool)
        fresh[block.starts] = True
        kept = np.where(self.is2[block.pairs.of], 2, self.is1[block.ids].astype(np.int8))
        begin = int(kept[-1])
        for lo in range(0, size, STRIDE):
            part = slice(lo, min(lo + STRIDE, size))
            last, pairs = block.last[part], block.pairs.of[part]
            arc3, arc2, from0 = self.arc3[block.trigrams.of[part]], self.arc2[pairs], self.root[block.ids[part]]
            from1 = np.where(np.isnan(arc2), self.fail1[block.ids[last]] + from0, arc2)
            from2 = np.where(np.isnan(arc3), self.fail2[block.pairs.of[last]] + from1, arc3)
            weights = []
            steps = zip(*(x.tolist() for x in (from0, from1, from2)), strict=True)
            for first, arcs, target in zip(fresh[part].tolist(), steps, kept[part].tolist(), strict=True):
                weights.append(arcs[begin if first else state])
                state = target
            out[part] = weights
        return out


def _score(block: _Block, answers: pa.Table, model: dict) -> pa.RecordBatch:
    block.types()
    machine = Automaton(block, answers, model)
    words = block.ids[:-1]
    add = lambda x: np.add.reduceat(x, block.starts)
    return pa.RecordBatch.from_arrays(
        [pa.array(block.doc_ids, pa.int64()), pa.array(block.held), pa.array(block.sizes),
         pa.array(add((machine.count[words] > 0).astype(np.int64))), pa.array(np.full(len(block.sizes), model["tokens"], np.int64)),
         pa.array(add(machine.base[words])), pa.array(add(machine.walk(block)))],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out: str) -> DataFrame:
    """One row for every row of ``docs``: (doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score).

    ``held_out`` is a SQL condition on ``docs``; null counts as false. Null and
    empty texts consist of their end only. Repeated rows count and are returned as
    often as they occur; a null doc_id is passed through. If nothing is left to
    train on, every word is unknown. Other columns are ignored; an empty table
    gives an empty table."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                         F.coalesce(F.expr(held_out), F.lit(False)).alias("held"))
    blocks = materialize(source.mapInArrow(_blocks, _BLOCK_SCHEMA), "lm-blocks")
    size = blocks.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")).alias("tokens"), F.count("*").alias("blocks")).first()
    if not size["blocks"]:
        return blocks.sparkSession.createDataFrame([], _SCORES)
    buckets = math.ceil(size["tokens"] / BUCKET_TOKENS)
    levels = max(1, math.ceil(math.log(buckets) / math.log(FAN) - 1e-9))
    fan = math.ceil(buckets ** (1 / levels) - 1e-9)

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                block.types(pairs=False)
                for kind, keys, counts in ((WORDS, *block.word_counts()), (TRIGRAMS, block.trigrams.keys, block.trigrams.counts)):
                    yield pa.RecordBatch.from_pylist(list(_ask(kind, block.block, 0, fan, fan, keys, counts)), _ASK)
                release()

    def asks_again(kind: int, sums, answers: DataFrame) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            out = pa.Table.from_pylist(list(_ask(kind, row["block"], 0, fan, fan, *sums(_Block(row), right))), _ASK)
            release()
            return out

        return blocks.groupBy("block").cogroup(answers.groupBy("node")).applyInArrow(run, _ASK_SCHEMA)

    first, stats1 = _exchange(blocks.mapInArrow(asks, _ASK_SCHEMA), fan, levels, size["blocks"])
    second, stats2 = _exchange(asks_again(PAIRS, _pair_sums, first.where(F.col("kind") == TRIGRAMS)), fan, levels, size["blocks"])
    third, _ = _exchange(asks_again(HEADS, _head_sums, second), fan, levels, size["blocks"])
    sums = {r["kind"]: r for r in stats1.unionByName(stats2).groupBy("kind").agg(
        *[F.sum(F.get("stats", F.lit(k))).alias(f"s{k}") for k in range(6)]).collect()}
    model = {"tokens": sums[WORDS]["s0"], "vocabulary": sums[WORDS]["s5"], "types": sums[PAIRS]["s5"],
             "discounts2": discounts(*(sums[PAIRS][f"s{k}"] for k in (1, 2, 3, 4))),
             "discounts3": discounts(*(sums[TRIGRAMS][f"s{k}"] for k in (1, 2, 3, 4)))}

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.Table.from_batches([_score(_Block(left.to_pylist()[0]), right, model)])
        release()
        return out

    answers = first.unionByName(second).unionByName(third)
    return blocks.groupBy("block").cogroup(answers.groupBy("node")).applyInArrow(scores, _SCORES)
