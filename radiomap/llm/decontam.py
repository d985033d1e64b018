"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words over all documents give TF-IDF
   weights. Words in more than ``COMMON`` of the documents weigh nothing, except
   the ``RAREST`` rarest words of every item, so that an item copied into a large
   share of the documents keeps its weights.
2. A randomised SVD of the TF-IDF passages of all documents and of all benchmark
   items spans the latent space. The passages stay in the tasks: each round sends
   back one words x rank matrix.
3. Every passage of every document, a window of ``WIDTH`` words every ``STEP``, is
   projected and compared by cosine with all items. Words that weigh nothing and
   an inexact latent space can keep the cosine low, so an exact route stands
   beside it: a find misses at most a known number of the item's words, so the
   text around its window holds ``RARE_SHARED`` of the rarest that many and
   ``RARE_SHARED`` more. Windows that do are compared whatever their cosine.
4. The words that item and text around the window have in common bound their
   longest common subsequence; where the bound allows a find, it is taken word
   by word. An item is found if it covers
   ``VERBATIM`` of the item, or ``PARAPHRASE`` of it together with the item's
   answer, its last sentence or line.

Items are the queries; they are searched in blocks of ``ITEM_BLOCK``, so what is
sent to the tasks is bounded however large the benchmark is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiomap.llm.text import PUNCTUATION, mix, pieces, releasing, slices, unused, utf8, word_keys
from radiomap.session import materialize

STEP, WIDTH = 16, 32
COMMON, COMMON_DOCUMENTS = 0.02, 100
RAREST = 8
RANK = 192
COSINE = 0.45
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
#: Items of fewer words have no paraphrase: they are found as exact word sequences.
LEAST_WORDS = 5
#: Content words of the benchmark that a window must hold to be compared.
LEAST_SHARED = 2
#: Words of an item's rarest that lead to a comparison whatever the cosine.
RARE_SHARED = 4
ITEM_BLOCK = 5_000
SEED = 10
#: Words whose rows of a product travel together, and items that are multiplied together.
_ROWS = 256
#: Bytes of text searched together.
_TOGETHER = 4 << 20
_STEP_KEY = np.uint64(0xD6E8FEB86659FD93)
#: Candidates whose words are laid side by side.
_CANDIDATES = 4096


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for x in b:
        hit = state & where.get(x, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


class Items:
    """A block of benchmark items: their vocabulary, words and answers in it."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        words = [word_keys([t.encode()], PUNCTUATION)[0] for _, t in rows]
        self.vocabulary = np.unique(np.concatenate(words)) if rows else np.empty(0, np.uint64)
        self.words = [self.columns(w) for w in words]
        self.answers = [self.columns(word_keys([self.answer(t).encode()], PUNCTUATION)[0]).tolist() for _, t in rows]
        self.sizes = np.array([len(w) for w in words])
        distinct = [np.unique(w, return_counts=True) for w in self.words]
        self.distinct = max((len(d) for d, _ in distinct), default=0)
        size = len(self.vocabulary)
        #: Sorted (item, word) pairs, each with the word's number in its item.
        self.pairs = np.concatenate([i * size + d for i, (d, _) in enumerate(distinct)] or [np.empty(0, np.int64)])
        self.place = np.concatenate([np.arange(len(d)) for d, _ in distinct] or [np.empty(0, np.int64)])
        self.times = np.zeros((len(rows), self.distinct), np.int64)
        for i, (_, n) in enumerate(distinct):
            self.times[i, :len(n)] = n

    @staticmethod
    def answer(text: str) -> str:
        """The last sentence or line of an item."""
        parts = [p for p in text.replace("\n", ". ").split(". ") if any(c.isalnum() for c in p)]
        return parts[-1] if parts else ""

    def columns(self, keys: np.ndarray) -> np.ndarray:
        """The place of each word in the vocabulary; -1 if it is not there."""
        at = np.minimum(np.searchsorted(self.vocabulary, keys), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == keys, at, -1)

    def common(self, item: np.ndarray, col: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
        """For tokens ``col`` of texts ``owner``, each compared with ``item[owner]``:
        (whether a token is a word of the item, by text how many words both have,
        counting repetitions; no common subsequence is longer)."""
        key = item[owner] * len(self.vocabulary) + col
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        shared = (col >= 0) & (self.pairs[at] == key)
        counts = np.bincount(owner[shared] * self.distinct + self.place[at[shared]], minlength=owners * self.distinct)
        return shared, np.minimum(counts.reshape(owners, self.distinct), self.times[item]).sum(axis=1)


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word keys, words by row) of the texts, in bounded pieces."""
    row = 0
    for run in pieces(utf8(column)):
        keys, counts = word_keys(run, PUNCTUATION)
        yield row, keys, counts
        row += len(run)


def document_frequencies(docs: DataFrame, items: Items) -> tuple[int, np.ndarray]:
    """(documents, documents with each word of the vocabulary), over all rows."""
    size = len(items.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for _, keys, counts in _tokens(batch.column(1)):
                col = items.columns(keys)
                doc = np.repeat(np.arange(len(counts)), counts)[col >= 0]
                pairs = np.unique(doc * size + col[col >= 0])
                total[:size] += np.bincount(pairs % size, minlength=size)
                total[size] += len(counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    found = dict(map(tuple, docs.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n")).collect()))
    every = np.array([found.get(k, 0) for k in range(size + 1)], np.int64)
    return int(every[size]), every[:size]


def weights(documents: int, frequency: np.ndarray, items: Items) -> np.ndarray:
    idf = np.log((1.0 + documents) / (1.0 + frequency)) + 1.0
    keep = frequency <= max(COMMON * documents, COMMON_DOCUMENTS)
    for words in items.words:
        own = np.unique(words)
        keep[own[np.argsort(frequency[own], kind="stable")[:RAREST]]] = True
    return np.where(keep, idf, 0.0)


class Rare:
    """The rarest words of each item, by word: no find lacks ``least`` of them."""

    def __init__(self, items: Items, frequency: np.ndarray):
        needed = np.ceil(PARAPHRASE * items.sizes - 1e-9).astype(np.int64)
        self.least = np.minimum(RARE_SHARED, needed)
        pairs = [np.empty((0, 2), np.int64)]
        for i, words in enumerate(items.words):
            rarest = words[np.argsort(frequency[words], kind="stable")[:len(words) - needed[i] + self.least[i]]]
            own = np.unique(rarest)
            pairs.append(np.stack([own, np.full(len(own), i)], axis=1))
        pairs = np.concatenate(pairs)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.item = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(items.vocabulary) + 1))

    def windows(self, every: np.ndarray, counts: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, run, item) of the windows around which the text holds
        ``least`` of the item's rarest words, once each."""
        doc = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(every)) - np.repeat(np.cumsum(counts) - counts, counts)
        n = np.where(every >= 0, self.first[every + 1] - self.first[every], 0)
        token = np.repeat(np.arange(len(every)), n)
        item = self.item[np.arange(len(token)) - np.repeat(np.cumsum(n) - n - self.first[every], n)]
        order = np.argsort(item, kind="stable")
        token, item = token[order], item[order]
        end = np.arange(len(token)) + self.least[item] - 1
        ok = np.flatnonzero(end < len(token))
        ok = ok[(item[end[ok]] == item[ok]) & (doc[token[end[ok]]] == doc[token[ok]])]
        item, doc, begin, end = item[ok], doc[token[ok]], place[token[ok]], place[token[end[ok]]]
        lo = np.maximum(-((WIDTH + items.sizes[item] - 1 - end) // STEP), 0)
        hi = np.minimum((begin + items.sizes[item]) // STEP, (counts[doc] - 1) // STEP)
        n = np.maximum(hi - lo + 1, 0)
        run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
        runs = int(counts.max(initial=0)) // STEP + 1
        key = np.unique((np.repeat(doc, n) * runs + run) * len(items.ids) + np.repeat(item, n))
        at, item = np.divmod(key, len(items.ids))
        return *np.divmod(at, runs), item


def _cells(col: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted words by runs of STEP words: (their columns, the first of each
    run, the run's document, the run's number in it)."""
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(col)) - np.repeat(np.cumsum(counts) - counts, counts)
    use = np.flatnonzero((col >= 0) & (weight[col] > 0))
    doc, run, col = doc[use], place[use] // STEP, col[use]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (run[1:] != run[:-1]))) if len(use) else use
    return col, first, doc[first], run[first]


def _windows(cells: np.ndarray, held: np.ndarray, doc: np.ndarray, run: np.ndarray):
    """Windows of two runs: (vectors, document, first run). A run's window starts
    at it, and at the run before if that holds nothing itself."""
    after = np.zeros(len(doc), bool)
    after[:-1] = (doc[1:] == doc[:-1]) & (run[1:] == run[:-1] + 1)
    nxt = np.minimum(np.arange(len(doc)) + 1, max(len(doc) - 1, 0))
    own = held + np.where(after, held[nxt], 0)
    keep = np.flatnonzero(own >= LEAST_SHARED)
    vectors = cells[keep] + cells[nxt[keep]] * after[keep, None]
    return vectors, doc[keep], run[keep]


def _repeated(items: Items) -> np.ndarray:
    """How often its item has each word of all items, word after word."""
    return np.concatenate([np.bincount(w)[w] for w in items.words])


def fit(docs: DataFrame, items: Items, weight: np.ndarray) -> np.ndarray:
    """Words x rank matrix of the leading right singular vectors of the passages of all documents and items.

    Range finder with one power round over passages that stay in the tasks: a
    task returns its part of A'(A Q), which Spark adds up by runs of words."""
    size = len(weight)
    rank = min(RANK, size)
    # The items' own passages as sparse rows: (word, weight) pairs, one row after another.
    word = np.concatenate(items.words)
    first = np.cumsum(items.sizes) - items.sizes
    norm = np.maximum(np.sqrt(np.add.reduceat(_repeated(items) * weight[word] ** 2, first)), 1e-12)
    value = weight[word] / np.repeat(norm, items.sizes)

    def own(basis: np.ndarray) -> np.ndarray:
        """A'(A Q) of the items, some rows at a time."""
        out = np.zeros((size, rank))
        for lo in range(0, len(items.sizes), _ROWS):
            hi = min(lo + _ROWS, len(items.sizes))
            part = slice(first[lo], first[hi - 1] + items.sizes[hi - 1])
            rows = np.add.reduceat(basis[word[part]] * value[part, None], first[lo:hi] - first[lo], axis=0)
            np.add.at(out, word[part], np.repeat(rows, items.sizes[lo:hi], axis=0) * value[part, None])
        return out

    def times(basis: np.ndarray) -> np.ndarray:
        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, rank))
            for batch in chain.from_iterable(slices(b, 1, _TOGETHER) for b in batches):
                for _, keys, counts in _tokens(batch.column(1)):
                    col, first, _, _ = _cells(items.columns(keys), counts, weight)
                    if not len(col):
                        continue
                    at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(col))))
                    norm = np.sqrt(np.maximum(np.add.reduceat(weight[col] ** 2, first), 1e-12))
                    x = weight[col] / norm[at]
                    y = np.add.reduceat(basis[col] * x[:, None], first, axis=0)
                    order = np.argsort(col, kind="stable")
                    own = np.flatnonzero(np.append(True, np.diff(col[order]) > 0))
                    total[col[order][own]] += np.add.reduceat(y[at[order]] * x[order, None], own, axis=0)
            starts = range(0, size, _ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(
                [total[s:s + _ROWS].astype(np.float32).tobytes() for s in starts], pa.binary())], ["k", "rows"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table["rows"].to_pylist())
            return pa.table({"k": table["k"][:1], "rows": pa.array([total.tobytes()], pa.binary())})

        schema = "k long, rows binary"
        out = own(basis)
        for k, rows in docs.mapInArrow(releasing(product), schema).groupBy("k").applyInArrow(add, schema).toLocalIterator():
            out[k:k + _ROWS] += np.frombuffer(rows).reshape(-1, rank)
        return out

    start = np.random.default_rng(SEED).standard_normal((size, rank))
    basis = np.linalg.qr(own(start) + 1e-3 * start)[0]
    image = times(basis)
    basis = np.linalg.qr(image)[0]
    return basis


def _search(batch: pa.RecordBatch, items: Items, rare: Rare, weight: np.ndarray, space: np.ndarray,
            queries: np.ndarray) -> list[tuple]:
    """(doc_id, item_id, cosine, lcs, answer_found, row) of one batch (doc_id, text,
    row), best by pair.

    ``space``: the latent vector of each word, weighted."""
    ids, marks, found = batch.column(0), batch.column(2), {}
    for row, keys, counts in _tokens(batch.column(1)):
        every = items.columns(keys)
        col, first, doc, run = _cells(every, counts, weight)
        held = np.diff(np.append(first, len(col)))
        cells = np.add.reduceat(space[col], first, axis=0) if len(col) else space[:0]
        vectors, doc, run = _windows(cells, held, doc, run)
        norm = np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
        near = vectors @ queries.T
        w, q = np.nonzero(near >= COSINE * norm[:, None])
        cosine = near[w, q] / norm[w]
        # The exact route: windows that the cosine has not led to; without weighted words it is 0.
        runs, own = int(counts.max(initial=0)) // STEP + 1, len(items.ids)
        window = doc * runs + run
        also_doc, also_run, also = rare.windows(every, counts, items)
        also_window = also_doc * runs + also_run
        new = ~np.isin(also_window * own + also, window[w] * own + q)
        also_doc, also_run, also, also_window = also_doc[new], also_run[new], also[new], also_window[new]
        if len(window):
            v = np.minimum(np.searchsorted(window, also_window), len(window) - 1)
            also_cosine = np.where(window[v] == also_window, near[v, also] / norm[v], 0.0)
        else:
            also_cosine = np.zeros(len(also))
        doc, run = np.append(doc[w], also_doc), np.append(run[w], also_run)
        q, cosine = np.append(q, also), np.append(cosine, also_cosine)
        begin = np.cumsum(counts) - counts
        at = run * STEP
        lo = begin[doc] + np.maximum(at - items.sizes[q], 0)
        hi = begin[doc] + np.minimum(at + WIDTH + items.sizes[q], counts[doc])
        for c in range(0, len(q), _CANDIDATES):
            part = slice(c, c + _CANDIDATES)
            size, item = (hi - lo)[part], q[part]
            owner = np.repeat(np.arange(len(size)), size)
            token = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[part], size)
            shared, most = items.common(item, every[token], owner, len(size))
            edges = np.append(0, np.cumsum(size))
            for k in np.flatnonzero(most >= PARAPHRASE * items.sizes[item]).tolist():
                i, d, cos = int(item[k]), row + int(doc[c + k]), float(cosine[c + k])
                span = slice(edges[k], edges[k + 1])
                text = every[token[span][shared[span]]].tolist()  # other words are in no common subsequence
                covered = lcs_length(items.words[i].tolist(), text) / int(items.sizes[i])
                answer = items.answers[i]
                told = bool(answer) and lcs_length(answer, text) >= ANSWER * len(answer)
                if covered >= VERBATIM or (covered >= PARAPHRASE and told):
                    best = found.get((d, i), (0.0, 0.0, False))
                    found[d, i] = (max(cos, best[0]), *max((covered, told), best[1:]))
    return [(ids[r].as_py(), items.ids[b], *x, marks[r].as_py()) for (r, b), x in sorted(found.items())]


_SCHEMA = "doc_id long, item_id long, cosine double, lcs double, answer_found boolean, row long"


class Sequences:
    """A block of items of few words, found where all their words stand side by side."""

    def __init__(self, rows: list[tuple[int, str]]):
        words = [word_keys([t.encode()], PUNCTUATION)[0] for _, t in rows]
        self.by_size = {}
        for n in sorted({len(w) for w in words}):
            own = [i for i, w in enumerate(words) if len(w) == n]
            keys = self._keys(np.stack([words[i] for i in own]).T)
            order = np.argsort(keys, kind="stable")
            self.by_size[n] = keys[order], np.array([rows[i][0] if rows[i][0] is not None else 0 for i in own])[order], \
                np.array([rows[i][0] is None for i in own])[order]

    @staticmethod
    def _keys(words: np.ndarray) -> np.ndarray:
        """A 64-bit key of each sequence, from the keys of its first words, second words..."""
        out = words[0]
        for w in words[1:]:
            out = mix(out * _STEP_KEY + w)
        return out

    def found(self, batch: pa.RecordBatch) -> list[tuple]:
        """As from ``_search``: the cosine is 0, all words and the answer are there."""
        ids, marks, out = batch.column(0), batch.column(2), []
        for row, keys, counts in _tokens(batch.column(1)):
            doc = np.repeat(np.arange(len(counts)), counts)
            for n, (own, items, nameless) in self.by_size.items():
                if len(keys) < n:
                    continue
                here = self._keys(np.stack([keys[k:len(keys) - n + 1 + k] for k in range(n)]))
                lo, hi = np.searchsorted(own, here), np.searchsorted(own, here, side="right")
                at = np.flatnonzero((hi > lo) & (doc[:len(here)] == doc[n - 1:]))
                hits = sorted({(int(doc[p]), k) for p in at.tolist() for k in range(lo[p], hi[p])})
                out += [(ids[row + d].as_py(), None if nameless[k] else int(items[k]), 0.0, 1.0, True, marks[row + d].as_py()) for d, k in hits]
        return out


def _item_blocks(benchmark: DataFrame, least: int, most: float = math.inf) -> Iterator[list[tuple[int, str]]]:
    """The items (id, text) with so many words, in blocks of bounded size."""
    rows: list[tuple[int, str]] = []
    usable = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    for i, t in usable.orderBy("item_id", "text").toLocalIterator():
        if least <= len(word_keys([t.encode()], PUNCTUATION)[0]) <= most:
            rows.append((i, t))
        if len(rows) == ITEM_BLOCK:
            yield rows
            rows = []
    if rows:
        yield rows


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer_found) for each item found in a row.

    ``lcs`` is the share of the item's words in the longest common subsequence,
    ``cosine`` the latent cosine of the closest window (0 if none holds weighted
    words). Items of fewer than five words are found where all their words stand
    side by side. Null or empty texts hold nothing; null items and items without
    words are not searched.
    Repeated rows (of either side) are found as often as they occur; a null
    doc_id or item_id is returned as such. Other columns are ignored; with either
    table empty the result is empty."""
    return _found(docs, benchmark, F.lit(0)).drop("row")


def _found(docs: DataFrame, benchmark: DataFrame, row: Column) -> DataFrame:
    """``leaks`` with the ``row`` that each is found in."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row.cast("long").alias("row"))
    out = docs.sparkSession.createDataFrame([], _SCHEMA)
    for rows in _item_blocks(benchmark, LEAST_WORDS):
        items = Items(rows)
        documents, frequency = document_frequencies(docs, items)
        weight = weights(documents, frequency, items)
        space = fit(docs, items, weight)
        queries = np.zeros((len(items.ids), space.shape[1]))
        for r, words in enumerate(items.words):
            queries[r] = weight[words] @ space[words]
        queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
        shared = docs.sparkSession.sparkContext.broadcast(
            (items, Rare(items, frequency), weight, (space * weight[:, None]).astype(np.float32), queries.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in chain.from_iterable(slices(b, 1, _TOGETHER) for b in batches):
                yield _rows(_search(batch, *shared.value))

        out = out.unionByName(docs.mapInArrow(releasing(run), _SCHEMA))
    for short in _item_blocks(benchmark, 1, LEAST_WORDS - 1):
        sequences = docs.sparkSession.sparkContext.broadcast(Sequences(short))

        def look(batches: Iterator[pa.RecordBatch], sequences=sequences) -> Iterator[pa.RecordBatch]:
            for batch in chain.from_iterable(slices(b, 1, _TOGETHER) for b in batches):
                yield _rows(sequences.value.found(batch))

        out = out.unionByName(docs.mapInArrow(look, _SCHEMA))
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      ["doc_id", "item_id", "cosine", "lcs", "answer_found", "row"])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns kept.

    Rows go by their own text, whatever other rows have the same id or none;
    cases otherwise as in ``leaks``."""
    mark, doc, row = F.xxhash64(F.col("text").cast("string")), unused(docs, "found_doc"), unused(docs, "found_row")
    bad = materialize(_found(docs, benchmark, mark).select(F.col("doc_id").alias(doc), F.col("row").alias(row)).distinct(), "leaking-docs")
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (mark == F.col(row)), "left_anti")
