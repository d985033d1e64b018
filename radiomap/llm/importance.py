"""Importance resampling towards a target, on hashed n-grams by prefix CRCs.

Texts are compared by how often their words and word pairs fall in each bucket of
a hash, the CRC-32 of the n-gram's bytes. No n-gram is ever written out. A text's
words, each followed by one space, are scanned once and the CRC of the text up to
each word is stored. CRC is linear over GF(2): shifted by the length of a piece,
the CRC of what comes before the piece cancels out of the CRC up to its end and
leaves that of the piece. So one shift of a stored prefix, one exclusive or and
one step backwards over the last space give any n-gram's CRC, in numpy for all
n-grams of a stretch of texts together.

Scale. Two passes over the documents: the first adds up the buckets (a task
sends at most one row a bucket), the second weighs every document by the gains
of its buckets. The gains have one number a bucket, whatever the corpus. Draws
are ranked by range partitions (``operators.indexing.row_index``), never in one
task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiomap.llm.text import named, pieces, utf8
from radiomap.operators.indexing import row_index
from radiomap.session import materialize

POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32 as in zip files
_ONES = np.uint32(0xFFFFFFFF)
#: Shifts up to this many bytes are one look-up; longer ones are made of powers of two of it.
SHORT = 64
#: Ranked documents that a partition is laid out for.
RANKED_ROWS = 2_000_000

#: Letters A-Z to lower case, ASCII other than letters and digits to a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _step_table() -> np.ndarray:
    """The CRC of each byte."""
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = np.where(v & 1, (v >> 1) ^ np.uint32(POLYNOMIAL), v >> 1)
    return v


_STEP = _step_table()
_BACK = np.argsort(_STEP >> 24).astype(np.uint32)  # the byte that gives a table value's highest byte


def _apply(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its values for each byte at each place."""
    return table[0, v & 255] ^ table[1, (v >> 8) & 255] ^ table[2, (v >> 16) & 255] ^ table[3, v >> 24]


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Maps that shift by 0 to ``SHORT`` - 1 bytes, and by ``SHORT`` * 2**k bytes."""
    places = np.arange(256, dtype=np.uint32)[None, :] << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]
    short = [places]
    for _ in range(SHORT):
        short.append(_STEP[short[-1] & 255] ^ (short[-1] >> 8))
    long = [short.pop()]
    for _ in range(30):
        long.append(_apply(long[-1], long[-1]))
    return np.stack(short), np.stack(long)


_SHORT, _LONG = _shift_tables()


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs moved on by n bytes each: what they add to the CRC of n bytes more."""
    few, many = n % SHORT, n // SHORT
    flat = _SHORT.reshape(-1)
    at = few * 1024
    out = flat[at + (crc & 255)] ^ flat[at + 256 + ((crc >> 8) & 255)] ^ flat[at + 512 + ((crc >> 16) & 255)] ^ flat[at + 768 + (crc >> 24)]
    k = 0
    while many.any():
        odd = (many & 1) > 0
        out[odd] = _apply(_LONG[k], out[odd])
        many, k = many >> 1, k + 1
    return out


def without_last(crc: np.ndarray, byte: int) -> np.ndarray:
    """The CRCs of texts that end in ``byte``, without it."""
    state = crc ^ _ONES
    index = _BACK[state >> 24]
    return (((state ^ _STEP[index]) << 8) | (index ^ np.uint32(byte))) ^ _ONES


def _scan(words: list[bytes]) -> list[int]:
    """The CRC of a text up to each of its words, and of the whole."""
    return list(accumulate([w + b" " for w in words], lambda crc, w: zlib.crc32(w, crc), initial=0))


def ngram_crcs(texts: list[bytes], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1 to ``longest`` (CRC-32 of each run of n words joined by a space, the
    text each comes from, words of each text)."""
    words = [t.translate(_NORMAL).split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    prefix = np.array(list(chain.from_iterable(map(_scan, words))), np.uint32)  # one more than words in every text
    size = np.zeros(len(prefix), np.int64)
    owner = np.repeat(np.arange(len(texts)), counts + 1)
    last = np.cumsum(counts + 1) - 1
    inner = np.ones(len(prefix), bool)
    inner[last] = False
    size[inner] = np.fromiter(map(len, chain.from_iterable(words)), np.int64, int(counts.sum())) + 1
    ends = np.append(0, np.cumsum(size))
    for n in range(1, longest + 1):
        at = np.flatnonzero(np.arange(len(prefix)) + n <= last[owner])
        joined = prefix[at + n] ^ shift(prefix[at], ends[at + n] - ends[at])
        yield without_last(joined, 32), owner[at], counts


def _buckets(texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every n-gram, text it comes from, words of each text)."""
    got = list(ngram_crcs(texts, longest))
    return (np.concatenate([g[0] for g in got]).astype(np.int64) % buckets, np.concatenate([g[1] for g in got]), got[0][2])


def bucket_counts(docs: DataFrame, longest: int = 2, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """(bucket, n): the n-grams of 1 to ``longest`` words of all rows by bucket, repeats
    counted; buckets without one are left out. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for run in pieces(utf8(b.column(0))):
                total += np.bincount(_buckets(run, longest, buckets)[0], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit])], ["bucket", "n"])

    counts = docs.select(F.col(named(text)).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of each bucket, both shares smoothed
    by one for each bucket; the tables are those of ``bucket_counts``."""
    s, t = np.zeros(buckets, object), np.zeros(buckets, object)
    for counts, into in ((source, s), (target, t)):
        for row in counts.collect():  # one row a bucket at most
            into[row.bucket] = row.n
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log(float(b + 1) * all_s / (float(a + 1) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 2) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row: its words, its n-grams, and the
    mean gain of their buckets, floored (0 without any)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            done = 0
            for run in pieces(utf8(b.column(1))):
                bucket, owner, counts = _buckets(run, longest, len(table))
                sums = np.zeros(len(run), np.int64)
                np.add.at(sums, owner, table[bucket])
                n = np.bincount(owner, minlength=len(run))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(done, len(run)), pa.array(counts), pa.array(n), pa.array(sums // np.maximum(n, 1))],
                    ["doc_id", "n_words", "n_features", "weight"])
                done += len(run)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = 10_000, least_words: int = 20,
             percent: int = 25, seed: int = 7) -> DataFrame:
    """Every row's (doc_id, n_features, weight, score, rank): rank 1, 2, 3... for the
    rows drawn, null for all others.

    Score is the weight plus Gumbel noise from ``seed`` and doc_id, so that taking
    the highest scores draws without replacement in proportion to exp(weight/1000).
    Of the rows with ``least_words`` or more, ``percent`` in a hundred are drawn (rounded
    down); ties go to the smaller doc_id, a null one last (its noise is that of an
    empty id), then to fewer n-grams and the lower weight. Null and empty texts have
    weight 0 and are never drawn. Repeated rows count as often as they occur; other
    columns are ignored; an empty table gives an empty table, an empty ``target``
    the same gain for every n-gram of equal frequency."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))
    scored = materialize(weigh(docs, gain, longest).withColumn("score", F.col("weight") + noise)
                         .withColumn("row", F.monotonically_increasing_id()), "resample")
    fit = F.col("n_words") >= least_words
    n = scored.where(fit).count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / RANKED_ROWS))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row")]
    ranked = row_index(scored.where(fit), order, name="rank", num_partitions=parts)
    drawn = F.when(F.col("rank") <= percent * n // 100, F.col("rank"))
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, drawn.alias("rank")).unionByName(scored.where(~fit).select(*out, F.lit(None).cast("long").alias("rank")))
