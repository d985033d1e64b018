"""Vectorised word splitting and word hashing for whole texts.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A word's 64-bit key is
a polynomial of its bytes modulo 2**64 (odd base, so prefix sums give any
word's value with one multiplication), passed through a bijective mixer.
Texts are hashed in pieces of about ``PIECE`` bytes, so the working memory does
not grow with the batch; a single longer text is one piece.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation: what is left are letters and digits.
PUNCTUATION = np.array([not chr(b).isalnum() for b in range(128)] + [False] * 128)
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, PIECE + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pieces(texts: list[bytes], size: int = PIECE) -> Iterator[list[bytes]]:
    """Consecutive runs of texts of about ``size`` bytes together."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > size:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t) + 1
    if run:
        yield run


def named(column: str) -> str:
    """A column's name as SQL takes it, whatever it holds."""
    return "`" + column.replace("`", "``") + "`"


def carried(frame: DataFrame, last: Column, *without: str) -> tuple[DataFrame, list[str], str]:
    """``frame`` without some columns and with ``last`` behind, under plain names, as
    functions in Python need them; the carried columns' own names; their schema."""
    fields = [f for f in frame.schema if f.name not in without]
    columns = [F.col(named(f.name)).alias(f"c{k}") for k, f in enumerate(fields)]
    schema = "".join(f"c{k} {f.dataType.simpleString()}, " for k, f in enumerate(fields))
    return frame.select(*columns, last.alias("last")), [f.name for f in fields], schema


def unused(frame: DataFrame, name: str) -> str:
    """``name``, or one like it, that no column of ``frame`` has."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sample_condition(share: float, seed: int, *columns: str) -> Column:
    """Whether a hash of the columns, a number of 63 bits, falls in the given share of all
    numbers: the same rows at every run, and some at however small a share."""
    if share >= 1:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 1) < F.lit(int(share * 2.0 ** 63))


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``size`` bytes of text together, or one longer text."""
    held = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(held), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def release() -> None:
    """Hand memory that this worker process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which the worker process, which Spark keeps for
    later tasks, releases its memory."""
    def run_and_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return run_and_release


class Words:
    """The words of a run of texts: raw bytes, starts, ends, keys, words per text."""

    def __init__(self, texts: list[bytes], breaks: np.ndarray = _SPACE):
        self.raw = raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        space = breaks[raw]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        up, down = _powers(len(raw))
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_LOWER[raw] * up[:len(raw)], out=total[1:])
        size = (self.ends - self.starts).astype(np.uint64)
        self.keys = mix((total[self.ends] - total[self.starts]) * down[self.starts] + size)
        #: Place of each text's first byte, and one past the last text's break.
        self.begin = np.cumsum([1] + [len(t) + 1 for t in texts])
        self.counts = np.diff(np.searchsorted(self.starts, self.begin))


def word_keys(texts: list[bytes], breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit key of every word of every text in order, words per text).

    ``breaks``: by byte, whether it separates words."""
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for run in pieces(texts):
        words = Words(run, breaks)
        keys.append(words.keys)
        counts.append(words.counts)
    return np.concatenate(keys), np.concatenate(counts).astype(np.int64)
