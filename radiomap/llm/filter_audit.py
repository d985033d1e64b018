"""Which document filters do the work: all orders of five filters, audited from a
sparse document-term matrix.

The matrix. Texts are packed into blocks of about ``BLOCK_BYTES``; each block counts
the words of its rows under numbers of its own. The blocks' distinct words are then
numbered across the corpus: dealt by a hash into buckets, encoded inside a bucket by
their rank there, so that number = rank * buckets + bucket, without any table of all
words in one place.
A block's numbers come back to it and it becomes a CSR shard (row starts, global
column numbers, counts). Row sums are words, nonzero entries distinct words.

The filters. Two are read off the shards; the others are attached to the rows:
two by characters and one by the SHA-256 of the text, whose least doc_id is found by
aggregation. What an order of filters removes at a step depends on which filters a
row fails, so rows are counted by part, failed filters and labels, at most 128 cells
a part, and all orders are read off the cells.

A frequent word is one row for each block at most; a large group of equal texts is
only aggregated and joined on (digest, doc_id). No table is broadcast by hint or
collected to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiomap.llm.text import named, release, releasing
from radiomap.session import materialize

#: Text in one block.
BLOCK_BYTES = 12 << 20
#: Words of blocks that one bucket of the dictionary is laid out for.
BUCKET_WORDS = 500_000
FILTERS = "ABCDE"
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"

_BLOCK = "block long, rows long, doc_ids array<long>, parts array<string>, digests array<binary>, fails array<int>, starts binary, columns binary, counts binary, n_words long, words binary"
_SHARD = "block long, doc_ids array<long>, parts array<string>, digests array<binary>, fails array<int>, starts binary, columns binary, counts binary"
_ROW = "doc_id long, part string, digest binary, fails int"


def _pack(x: np.ndarray) -> bytes:
    """An integer array as its byte planes, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class _Block:
    """Rows gathered for one block, and the matrix under the block's own word numbers."""

    def __init__(self, number: int):
        self.number, self.full = number, 0
        self.rows: list[tuple] = []
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.sizes: list[int] = []
        self.columns: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_id: int | None, part: str | None, text: str | None) -> None:
        raw = (text or "").encode()
        count = Counter(raw.split())  # white space of bytes is space and \t to \r
        capitals = len(raw) - len(raw.translate(None, _CAPITALS))
        fails = 4 * (100 * capitals > 2 * len(text or "")) + 8 * (len(raw) != len(raw.translate(None, _SYMBOLS)))
        self.rows.append((doc_id, part or "", hashlib.sha256(raw).digest(), fails))
        self.sizes.append(len(count))
        self.columns.append(np.fromiter(map(self.words.__getitem__, count), np.int32, len(count)))
        self.counts.append(np.fromiter(count.values(), np.int32, len(count)))
        self.full += len(raw)

    def batch(self) -> pa.RecordBatch:
        ids, parts, digests, fails = zip(*self.rows, strict=True)
        starts = np.append(0, np.cumsum(self.sizes))
        columns = np.concatenate(self.columns)
        often = np.argsort(-np.bincount(columns, minlength=len(self.words)), kind="stable")  # small numbers pack well
        place = np.empty(len(often), np.int32)
        place[often] = np.arange(len(often), dtype=np.int32)
        words = list(self.words)
        words = zstandard.ZstdCompressor(level=1).compress(b" ".join([words[k] for k in often.tolist()]))
        values = [self.number, len(ids), list(ids), list(parts), list(digests), list(fails), _pack(starts),
                  _pack(place[columns]), _pack(np.concatenate(self.counts)), len(often), words]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.int32()),
                 pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        names = [f.split(" ")[0] for f in _BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, part, text) as blocks; their numbers are unique by partition."""
    block = _Block(TaskContext.get().partitionId() << 32)
    for batch in batches:
        for row in range(0, batch.num_rows, 256):
            part = batch.slice(row, 256)
            for doc_id, source, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if block.rows and block.full + len(text or "") > BLOCK_BYTES:
                    yield block.batch()
                    block = _Block(block.number + 1)
                block.add(doc_id, source, text)
    if block.rows:
        yield block.batch()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of blocks (block, words) as rows (block, place, word)."""
    for batch in batches:
        for row in batch.to_pylist():
            raw = zstandard.ZstdDecompressor().decompress(row["words"])
            words = raw.split(b" ") if raw else []
            for start in range(0, len(words), 50_000):
                part = words[start:start + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), row["block"])), pa.array(np.arange(start, start + len(part), dtype=np.int32)),
                     pa.array(part, pa.binary())], ["block", "place", "word"])


def _ranks(words: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(distinct words in order, the place there of each word): the same however the
    rows arrive, so that a task that runs again gives the same numbers."""
    coded = words.cast(pa.large_binary()).combine_chunks().dictionary_encode()
    order = pa.compute.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


def _shard(block: pa.Table, numbers: pa.Table) -> pa.Table:
    """A block with the global number of each of its words: a CSR shard."""
    release()
    column = np.empty(numbers.num_rows, np.int64)
    column[numbers.column("place").to_numpy()] = numbers.column("column").to_numpy()
    kept = block.select(["block", "doc_ids", "parts", "digests", "fails"])
    for name, kind in (("starts", np.int64), ("columns", np.int32), ("counts", np.int32)):
        values = [_unpack(x.as_py(), kind) for x in block.column(name)]
        kept = kept.append_column(name, pa.array([(column[v] if name == "columns" else v).tobytes() for v in values], pa.binary()))
    return kept


def matrix(docs: DataFrame, part: str = "source") -> tuple[DataFrame, DataFrame]:
    """(CSR shards of the document-term matrix, dictionary).

    A shard has its rows' doc_ids, parts (null: empty), text digests and the bits of
    the filters C and D, row ``starts`` and column numbers (64-bit integers) and
    ``counts`` (32-bit). The dictionary has a row (word, column) for each distinct word.
    A null or empty text is a row without entries."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), F.col(named(part)).cast("string"), F.col("text").cast("string"))
    blocks = materialize(source.mapInArrow(releasing(_blocks), _BLOCK), "matrix-blocks")
    found = blocks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(found / BUCKET_WORDS))
    words = blocks.select("block", "words").mapInArrow(releasing(_words), "block long, place int, word binary")
    dealt = words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")).groupBy("bucket")

    def number(key: tuple, table: pa.Table) -> pa.Table:
        _, rank = _ranks(table.column("word"))
        release()
        return pa.table({"block": table.column("block"), "place": table.column("place"), "column": rank * buckets + key[0].as_py()})

    def entries(key: tuple, table: pa.Table) -> pa.Table:
        distinct, _ = _ranks(table.column("word"))
        return pa.table({"word": distinct.cast(pa.binary()), "column": np.arange(len(distinct)) * buckets + key[0].as_py()})

    numbered = dealt.applyInArrow(number, "block long, place int, column long")
    shards = blocks.groupBy("block").cogroup(numbered.groupBy("block")).applyInArrow(_shard, _SHARD)
    return shards, dealt.applyInArrow(entries, "word binary, column long")


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CSR shards as rows (doc_id, part, digest, failed filters A to D)."""
    for batch in batches:
        for row in range(batch.num_rows):
            shard = {name: batch.column(name)[row] for name in ("doc_ids", "parts", "digests", "fails", "starts", "counts")}
            starts = np.frombuffer(shard["starts"].as_buffer(), np.int64)
            total = np.append(0, np.cumsum(np.frombuffer(shard["counts"].as_buffer(), np.int32), dtype=np.int64))
            words, distinct = total[starts[1:]] - total[starts[:-1]], np.diff(starts)
            fails = shard["fails"].values.to_numpy() + 1 * (words < 200) + 2 * (100 * distinct < 50 * words)
            yield pa.RecordBatch.from_arrays([shard["doc_ids"].values, shard["parts"].values, shard["digests"].values, pa.array(fails.astype(np.int32))],
                                             ["doc_id", "part", "digest", "fails"])


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, digest, fails) of each row: a bit for each failed filter, 1 (A) to 8 (D)."""
    return matrix(docs, part)[0].mapInArrow(releasing(_decide), _ROW)


def _cells(docs: DataFrame, labels: DataFrame, part: str) -> DataFrame:
    """(part, fails, n, good, toxic): rows by failed filters, a bit each, E's being 16."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failures(docs, part).join(marks, "doc_id", "left").na.fill(False, ["good", "toxic"])
    by = ["part", "fails", "good", "toxic"]
    one = materialize(rows.groupBy("digest", "doc_id", *by).agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    first = one.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    # A row without doc_id is neither before nor after any other.
    fresh = one.join(first, ["digest", "doc_id"], "left_semi").unionByName(one.where("doc_id is null"))
    counted = one.groupBy(*by).agg(F.sum("n").alias("n")).withColumn("fails", F.col("fails") + 16)
    kept = fresh.groupBy(*by).agg(F.sum("n").alias("n"))
    moved = kept.withColumn("fails", F.col("fails") + 16).withColumn("n", -F.col("n"))
    either = counted.unionByName(kept).unionByName(moved)
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return either.groupBy("part", "fails").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def _sum(of: str, condition: str) -> Column:
    """The sum of a field over the cells that meet a condition."""
    return F.expr(f"aggregate(filter(cells, c -> {condition}), 0L, (a, c) -> a + {of})")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """For each part, each order of the filters A to E and each step: documents kept
    after it, removed by it, redundant (they fail its filter but were removed earlier),
    unique_fails (they fail its filter only), good_lost and toxic_lost (removed,
    with a label quality = 1 or toxic = 1), and shapley (its filter's removed over
    all orders).

    Filters fail: A under 200 words; B fewer distinct words than half; C over 2 %
    capitals; D one of ``#$%&*|``; E the text of a smaller doc_id.
    Null texts count as empty, null parts as the empty part. Repeated rows count as
    often as they occur (the same doc_id isn't smaller: E spares them); a null doc_id
    never fails E and has no label. Of repeated labels any may mark a document; other
    columns are ignored; an empty table gives an empty table."""
    cells = _cells(docs, labels, part).groupBy("part").agg(  # at most 32 cells a part
        F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    own = F.expr("shiftleft(1, ascii(substring(filter_order, step, 1)) - 65)")
    before = F.expr(" + ".join(f"if(instr(filter_order, '{c}') < step, {1 << k}, 0)" for k, c in enumerate(FILTERS)))
    steps = steps.withColumn("own", own).withColumn("before", before)
    here = "(c.fails & before) = 0 and (c.fails & own) != 0"
    return steps.select(
        "part", "filter_order", "step",
        _sum("c.n", "(c.fails & (before | own)) = 0").alias("kept"),
        _sum("c.n", here).alias("removed"),
        _sum("c.n", "(c.fails & before) != 0 and (c.fails & own) != 0").alias("redundant"),
        _sum("c.n", "c.fails = own").alias("unique_fails"),
        _sum("c.good", here).alias("good_lost"),
        _sum("c.toxic", here).alias("toxic_lost"),
        _sum("c.n * (120 div bit_count(c.fails))", "(c.fails & own) != 0").alias("shapley"))
