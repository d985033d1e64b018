"""SimHash near-duplicates by the generalised pigeonhole principle.

1. A text's fingerprint: the majority bits of the XXH64 values of its word
   shingles. Equal fingerprints collapse into one row before any search.
2. Bits that are correlated over all fingerprints are grouped into the same
   partition, which leaves the others selective.
3. Partition i gets its own threshold t_i >= -1 with sum(t_i + 1) = d + 1: two
   fingerprints within d bits then agree within t_i bits on some partition.
   Dynamic programming takes the allocation with the least estimated cost, from
   the measured collisions of every partition.
4. A partition with t_i < 0 is not probed. For the others every fingerprint
   probes the values within t_i bits of its own and the meeting pairs are
   verified on all 64 bits.

A bucket with more than ``HOT`` fingerprints would give pairs in the square of
its size. Its members are linked without pairs and without loss: two
fingerprints are within 2 bits exactly if they or their one-bit neighbours
meet, so all that share such a neighbour are joined to the least of them (for d
bits: neighbours within ceil(d/2), then verified). Links found are all true; the
components are those of all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiomap.llm.graph import components
from radiomap.llm.text import named, unused, utf8
from radiomap.session import materialize

BITS = 64
SHINGLE = 3
MAX_BITS = 2
#: Largest number of fingerprints in a bucket that is joined pair by pair.
HOT = 64
_LANES = ((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)) \
    .astype(np.uint8).view(np.uint64).ravel()


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text the 64 majority bits of its hashes (0 for a text without any).

    Eight one-bit counters share a 64-bit lane, so runs of up to 255 hashes are
    added with whole-lane sums before they are widened."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    start = np.cumsum(n) - n
    runs = -(-n // 255)
    first = np.cumsum(runs) - runs
    at = np.repeat(start, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    lanes = _LANES[np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)]
    part = np.add.reduceat(lanes, at, axis=0).view(np.uint8)
    ones = np.add.reduceat(part, first, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 (seed 42) of each shingle; fewer words: of the whole sequence."""
    words = text.lower().split()
    if not words:
        return []
    rows = [words] if len(words) < size else zip(*(words[i:] for i in range(size)), strict=False)
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, rows), repeat(42)))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, out, held, counts = utf8(batch.column(1)), [], [], []
        for t in texts:
            held.append(np.array(shingle_hashes(t, size), np.uint64))
            counts.append(len(held[-1]))
            if sum(counts) > 200_000:
                out.append(majority(np.concatenate(held), np.array(counts)))
                held, counts = [], []
        if counts:
            out.append(majority(np.concatenate(held), np.array(counts)))
        bits = np.concatenate(out) if out else np.empty(0, np.uint64)
        rest = [i for i in range(batch.num_columns) if i != 1]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(bits.view(np.int64))],
                                         [*(batch.schema.names[i] for i in rest), "fp"])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; null text counts as empty: fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda b: _fingerprint_batches(b, size), "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, 64 x 64 counts of bits set together) over all fingerprints."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = np.unpackbits(np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint8).reshape(-1, 8),
                              axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            rows += len(x)
        values = np.append(total.ravel(), rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["k", "v"])

    cells = dict(map(tuple, fps.select("fp").mapInArrow(count, "k long, v double")
                     .groupBy("k").agg(F.sum("v").alias("v")).collect()))
    values = np.array([cells.get(k, 0.0) for k in range(BITS * BITS + 1)])
    return int(values[-1]), values[:-1].reshape(BITS, BITS)


def group_bits(rows: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` groups of bits; correlated bits go into the same group."""
    mean = np.diag(together) / max(rows, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    link = np.abs((together / max(rows, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(link, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        room = len(free) // (parts - k)
        group = [max(free, key=lambda b: (link[b, free].max(), -b))]
        free.remove(group[0])
        while len(group) < room:
            nxt = max(free, key=lambda b: (link[b, group].sum(), -b))
            group.append(nxt)
            free.remove(nxt)
        groups.append(sorted(group))
    return groups


def ball(width: int, t: int) -> int:
    """Values of ``width`` bits within t bits of a given one."""
    return sum(math.comb(width, j) for j in range(t + 1))


def spread_of(group: list[int], mean: np.ndarray, most: int) -> np.ndarray:
    """By t: meeting pairs within t bits of a group, as a multiple of those at 0.

    For independent bits, the pairs that differ on a bit outnumber those that
    agree on it by (1 - p) / p, p the share of agreeing pairs."""
    agree = mean[group] ** 2 + (1 - mean[group]) ** 2
    poly = np.zeros(most + 1)
    poly[0] = 1
    for odds in (1 - agree) / agree:
        poly[1:] += odds * poly[:-1]
    return np.cumsum(poly)


def allocate(cost: list[np.ndarray], total: int) -> tuple[float, list[int]]:
    """Thresholds of least summed cost with sum(t_i + 1) = total, by dynamic
    programming; cost[i][t + 1] is what threshold t costs on partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for s in range(min(len(own), total - used + 1)):
                got = (c + float(own[s]), [*ts, s - 1])
                if used + s not in nxt or got < nxt[used + s]:
                    nxt[used + s] = got
        best = nxt
    return best[total]


def _costs(rows: int, groups: list[list[int]], mean: np.ndarray, meeting: list[float], most: int) -> list[np.ndarray]:
    """Rows to shuffle and pairs to verify by partition and threshold."""
    return [np.concatenate([[0.0], [rows * (ball(len(g), t) + (t > 0)) + meet * s
                                    for t, s in enumerate(spread_of(g, mean, most))]])
            for g, meet in zip(groups, meeting, strict=True)]


def plan(fps: DataFrame, max_bits: int = MAX_BITS) -> list[tuple[int, list[int], int]]:
    """[(mask, bits, threshold)] of the partitions to probe, for these fingerprints.

    The number of partitions is that of least cost if bits were independent;
    the thresholds then follow the collisions measured on each partition."""
    rows, together = bit_statistics(fps)
    mean = np.diag(together) / max(rows, 1)
    options = []
    for parts in range(1, max_bits + 3):
        groups = group_bits(rows, together, parts)
        meeting = [rows * (rows - 1) / 2 * float(np.prod(mean[g] ** 2 + (1 - mean[g]) ** 2)) for g in groups]
        options.append((allocate(_costs(rows, groups, mean, meeting, max_bits), max_bits + 1)[0], groups))
    groups = min(options, key=lambda x: x[0])[1]
    masks = [sum(1 << b for b in g) for g in groups]
    measured = dict(map(tuple, _own_values(fps, list(enumerate(masks))).groupBy("part", "value").count()
                        .groupBy("part").agg(F.sum(F.expr("double(count) * (count - 1) / 2"))).collect()))
    costs = _costs(rows, groups, mean, [measured.get(i, 0.0) for i in range(len(groups))], max_bits)
    chosen = allocate(costs, max_bits + 1)[1]
    return [(m, g, t) for m, g, t in zip(masks, groups, chosen, strict=True) if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _own_values(fps: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"))
                     for i, m in masks])
    return fps.select("fp", F.inline(rows))


def _flips(bits: list[int], t: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for j in range(1, t + 1) for c in combinations(bits, j)]


def _near(a: str | Column, b: str | Column, max_bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """True links (a, b) whose components are those of all pairs within
    ``max_bits``, for distinct fingerprints ``fp``."""
    chosen = plan(fps, max_bits)
    own = _own_values(fps, [(i, m) for i, (m, _, _) in enumerate(chosen)])
    size = own.groupBy("part", "value").agg(F.count("*").alias("n"))
    own = own.join(size, ["part", "value"])
    few, many = own.where(F.col("n") <= hot), own.where(F.col("n") > hot)
    found = []
    exact = [i for i, (_, _, t) in enumerate(chosen) if t == 0]
    wide = [i for i, (_, _, t) in enumerate(chosen) if t > 0]
    if exact:
        a = few.where(F.col("part").isin(exact) & (F.col("n") > 1)).select("part", "value", F.col("fp").alias("a"))
        b = a.withColumnRenamed("a", "b")
        found.append(a.join(b, ["part", "value"]).where("a < b").where(_near("a", "b", max_bits)).select("a", "b"))
    crowded = many.select("fp").distinct()
    for i in wide:
        mask, bits, t = chosen[i]
        value = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        steps = F.array(F.lit(0), *[F.lit(x) for x in _flips(bits, t)]).cast("array<long>")
        probe = fps.select(F.col("fp").alias("b"), value.alias("own"), F.explode(steps).alias("step")).select(
            "b", F.col("own").bitwiseXOR(F.col("step")).alias("value"))
        a = few.where(F.col("part") == i).select("value", F.col("fp").alias("a"))
        found.append(a.join(probe, "value").where("a <> b").where(_near("a", "b", max_bits)).select("a", "b"))
        full = many.where(F.col("part") == i).select("value").distinct()
        crowded = crowded.unionByName(probe.join(full, "value", "left_semi").select(F.col("b").alias("fp")))
    found.append(_crowded_links(crowded.distinct(), max_bits))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _crowded_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links among fingerprints of crowded buckets through shared neighbours.

    Neighbours within ceil(d / 2) bits meet for every pair within d bits. For
    even d all that share one are within d bits, so a star keeps the components;
    for odd d a shared neighbour is within ceil(d / 2) on both sides, so pairs
    of one group are verified (d = 1: the neighbour is one of the two)."""
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    if max_bits % 2:
        other = fps.select(F.col("fp").alias("b"), F.explode(
            F.array(*[F.lit(x) for x in _flips(list(range(BITS)), max_bits)])).alias("s"))
        other = other.select("b", F.col("b").bitwiseXOR(F.col("s")).alias("a"))
        return other.join(fps.select(F.col("fp").alias("a")), "a", "left_semi").select("a", "b")
    steps = F.array(F.lit(0), *[F.lit(x) for x in _flips(list(range(BITS)), max_bits // 2)]).cast("array<long>")
    meet = fps.select("fp", F.explode(steps).alias("s")).select("fp", F.col("fp").bitwiseXOR(F.col("s")).alias("mid"))
    least = meet.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("mid", "a")
    return meet.join(least, "mid").where("fp <> a").select("a", F.col("fp").alias("b"))


def _with_components(marks: DataFrame, max_bits: int, hot: int) -> DataFrame:
    """(fp, component_id) of the fingerprints in ``marks`` (doc_id, fp)."""
    distinct = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fps")
    parts = components(links(distinct.select("fp"), max_bits, hot))
    rooted = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rooted.join(first, "root").select("fp", "root", "component_id")


def simhash_groups(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Null or empty texts and texts of white space alone have fingerprint zero and
    are linked like any other; a text with fewer words than ``size`` is one
    shingle. Repeated rows are returned as often as they occur. A null doc_id
    keeps its row; it never is a component_id unless no member has an id. Other
    columns are ignored; an empty table gives an empty table."""
    marks = materialize(fingerprints(docs, size), "fingerprints")
    known = _with_components(marks, max_bits, hot).select("fp", "component_id")
    return marks.join(known, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """``docs`` with one row left of each group: that of the smallest doc_id (rows
    without one come last), ties by a hash of the row. All columns stay; cases
    otherwise as in ``simhash_groups``."""
    key, mark, doc, row = F.xxhash64(*[F.col(named(c)) for c in docs.columns]), *(unused(docs, c) for c in ("the_key", "best_doc", "best_row"))
    rows = docs.select("doc_id", "text", key.alias("row"))
    marks = materialize(rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "row").mapInArrow(
        lambda b: _fingerprint_batches(b, size), "doc_id long, row long, fp long"), "fingerprints")
    roots = _with_components(marks, max_bits, hot).select("fp", "root")
    best = marks.join(roots, "fp").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("best"))
    best = best.select(F.col("best.doc_id").alias(doc), F.col("best.row").alias(row))
    kept = docs.withColumn(mark, key)
    kept = kept.join(best, (F.col(mark) == F.col(row)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left_semi")
    return kept.dropDuplicates([mark, "doc_id"]).drop(mark)
