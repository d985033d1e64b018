"""Exact k-nearest fingerprints without a cross join of scans.

Each scan is a vector over the AP catalogue with x = rssi - fill (fill = -110
dBm, so "not heard" is 0). The squared distance of a query q and a training scan
t is A + B - 2 dot(q, t), A and B their squared norms; the dot product only has
terms for APs that both hear. Nothing is assumed of the sign of x, and training
scans that share no AP with the query, or hear nothing, take part like any other.

Where the training scans fit a tile for each core, they are dealt into tiles by a hash
of the id, so an AP heard by a third of all scans is spread evenly. A task gets one
tile and one block of queries: it multiplies the two sparse matrices in bounded dense
pieces and keeps the k nearest of its tile for every query. Only those k rows are
shuffled again.

Beyond that a pivot index decides which scans a query meets at all. Pivots are training
scans drawn by a hash, at most ``MOST_PIVOTS``, sent to the tasks; every training
scan belongs to its nearest pivot. A query first meets the nearest groups that hold
k scans. The k-th distance found there bounds what can still matter: by the
triangle inequality a group is left out if its ring around the pivot, or its side of
the plane between its pivot and the query's nearest, is farther away. The other
groups are met in a second pass. A group of many scans or visitors is laid out over a
grid of tasks, by hashes of both ids. The result is exact; how much is left out
depends on how the scans cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from radiomap.functions.signal import FILL_DBM
from radiomap.session import materialize, ship

K = 3  # fixed value: neighbours used by the survey's nearest-fingerprint models
TILE_SCANS = 8192  # scans of one side in a task, at most about
PIVOT_SCANS = 2048  # training scans for which a pivot is drawn
MOST_PIVOTS = 2048  # bounds what the tasks are sent and the work of finding a scan's pivot
_ROWS, _COLUMNS = 512, 4096  # dense piece of one product
_MEETINGS = 4  # meetings of entries for each product of two rows, up to which they are multiplied one by one


def _vectors(ids: DataFrame, reading: DataFrame, fill: int) -> DataFrame:
    """(id, aps, xs): each scan with the APs it hears, at the strongest reading."""
    r = reading.join(ids, "obs_id", "left_semi").groupBy("obs_id", "ap_id").agg(
        F.max((F.col("rssi") - F.lit(fill)).cast("bigint")).alias("x"))
    per = r.groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("ap_id", "x"))).alias("v"))
    v = F.coalesce(F.col("v"), F.array().cast("array<struct<ap_id:string,x:bigint>>"))
    return ids.join(per, "obs_id", "left").select(F.col("obs_id").cast("bigint").alias("id"), v.alias("v")).select(
        "id", F.col("v.ap_id").alias("aps"), F.col("v.x").alias("xs"))


def _sparse(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(ids in order, row of each entry, AP of each entry, x of each entry)."""
    table = table.select(["id", "aps", "xs"]).sort_by("id").combine_chunks()
    aps, xs = table["aps"].combine_chunks(), table["xs"].combine_chunks()
    sizes = pa.compute.list_value_length(aps).to_numpy(zero_copy_only=False).astype(np.int64)
    return table["id"].to_numpy(), np.repeat(np.arange(len(sizes)), sizes), aps.flatten(), xs.flatten().to_numpy().astype(np.float64)


def _columns(aps: pa.Array, names: pa.Array) -> np.ndarray:
    """The place of each AP among ``names``, -1 for others."""
    return pa.compute.fill_null(pa.compute.index_in(aps, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _dense(rows: np.ndarray, cols: np.ndarray, xs: np.ndarray, lo: int, hi: int, c0: int, c1: int) -> np.ndarray:
    out = np.zeros((hi - lo, c1 - c0))
    use = (rows >= lo) & (rows < hi) & (cols >= c0) & (cols < c1)
    out[rows[use] - lo, cols[use] - c0] = xs[use]
    return out


def _products(q: tuple[np.ndarray, ...], t: tuple[np.ndarray, ...], rows: int, others: int, columns: int) -> np.ndarray:
    """The dot products (rows, others) of two sets of sparse rows, each (row, column,
    value) with columns below ``columns``. Entries that meet are multiplied one by
    one where that is less than a dense product, else in bounded dense pieces. Values
    are whole numbers, so both give the same."""
    (q_rows, q_cols, q_x), (t_rows, t_cols, t_x) = q, t
    order = np.argsort(q_cols, kind="stable")
    held = np.bincount(q_cols, minlength=columns)
    n = held[t_cols]
    if n.sum() <= _MEETINGS * rows * others:
        token = np.repeat(np.arange(len(t_cols)), n)
        own = order[np.arange(len(token)) - np.repeat(np.cumsum(n) - n - (np.cumsum(held) - held)[t_cols], n)]
        place = q_rows[own] * others + t_rows[token]
        return np.bincount(place, weights=q_x[own] * t_x[token], minlength=rows * others).reshape(rows, others)
    out = np.zeros((rows, others))
    for c0 in range(0, columns, _COLUMNS):
        c1 = c0 + _COLUMNS
        out += _dense(q_rows, q_cols, q_x, 0, rows, c0, c1) @ _dense(t_rows, t_cols, t_x, 0, others, c0, c1).T
    return out


def _span(rows: np.ndarray, cols: np.ndarray, xs: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of rows lo to hi whose column is known; ``rows`` ascends."""
    at = slice(*np.searchsorted(rows, (lo, hi)))
    use = cols[at] >= 0
    return rows[at][use] - lo, cols[at][use], xs[at][use]


def _least(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least of every row by (d, id), in that order."""
    k = min(k, d.shape[1])
    row, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1:k])
    order = np.lexsort((ids[row, col], d[row, col], row))
    first = np.searchsorted(row, np.arange(len(d)))
    at = order[first[:, None] + np.arange(k)]
    return d[row[at], col[at]], ids[row[at], col[at]]


def nearest_in_tile(queries: pa.Table, tile: pa.Table, k: int) -> pa.Table:
    """The k nearest scans of one tile for each query of one block, by (d2, id)."""
    q_ids, q_rows, q_aps, q_x = _sparse(queries)
    t_ids, t_rows, t_aps, t_x = _sparse(tile)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(q_ids) and len(t_ids):
        names = q_aps.unique()
        q_cols, t_cols = _columns(q_aps, names), _columns(t_aps, names)
        b = np.bincount(t_rows, weights=t_x * t_x, minlength=len(t_ids))
        a = np.bincount(q_rows, weights=q_x * q_x, minlength=len(q_ids))
        for lo in range(0, len(q_ids), _ROWS):
            hi = min(lo + _ROWS, len(q_ids))
            best_d = np.empty((hi - lo, 0))
            best_i = np.empty((hi - lo, 0), np.int64)
            q = _span(q_rows, q_cols, q_x, lo, hi)
            for t0 in range(0, len(t_ids), _ROWS):
                t1 = min(t0 + _ROWS, len(t_ids))
                dot = _products(q, _span(t_rows, t_cols, t_x, t0, t1), hi - lo, t1 - t0, len(names))
                d = np.concatenate([best_d, a[lo:hi, None] + b[None, t0:t1] - 2 * dot], axis=1)
                ids = np.concatenate([best_i, np.broadcast_to(t_ids[t0:t1], (hi - lo, t1 - t0))], axis=1)
                best_d, best_i = _least(d, ids, k)
            found.append((np.repeat(q_ids[lo:hi], best_d.shape[1]), best_i.ravel(), best_d.ravel()))
    columns = [np.concatenate(c) if found else np.empty(0) for c in (zip(*found, strict=True) if found else [[]] * 3)]
    return pa.table({n: pa.array(np.asarray(c, np.int64)) for n, c in zip(("query_id", "neighbor_id", "d2"), columns, strict=True)})


def _parts(n: int, cores: int) -> int:
    """Parts of n scans: none larger than a tile, and where there are few, enough
    to give the cores work."""
    return max(1, math.ceil(n / TILE_SCANS), min(cores, math.ceil(n / 512)))


@dataclass
class Pivots:
    """The entries (row, column, value) of the pivots' vectors over the APs that they hear,
    their squared norms, and, once known, the scans, the least and the largest distance
    of each pivot's group."""

    names: pa.Array
    entries: tuple[np.ndarray, np.ndarray, np.ndarray]
    norms: np.ndarray
    count: np.ndarray | None = None
    near: np.ndarray | None = None
    far: np.ndarray | None = None

    @classmethod
    def of(cls, rows: pa.Table) -> Pivots:
        ids, row, aps, x = _sparse(rows)
        names = aps.unique()
        return cls(names, (row, _columns(aps, names), x), np.bincount(row, weights=x * x, minlength=len(ids)))

    def distances(self, batch: pa.RecordBatch) -> np.ndarray:
        """(rows, pivots), exact but for the root: entries are whole numbers."""
        aps, xs = batch.column("aps"), batch.column("xs")
        row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(aps).to_numpy(zero_copy_only=False).astype(np.int64))
        col, x = _columns(aps.flatten(), self.names), xs.flatten().to_numpy().astype(np.float64)
        own = np.bincount(row, weights=x * x, minlength=batch.num_rows)
        known = col >= 0
        dot = _products((row[known], col[known], x[known]), self.entries, batch.num_rows, len(self.norms), len(self.names))
        square = own[:, None] + self.norms[None, :] - 2 * dot
        return np.sqrt(np.maximum(square, 0))

    def first(self, distance: np.ndarray, k: int) -> np.ndarray:
        """Whether a query meets a group at first: the nearest that together hold k scans."""
        order = np.argsort(distance, axis=1, kind="stable")
        held = np.cumsum(self.count[order], axis=1) - self.count[order]
        out = np.zeros(distance.shape, bool)
        np.put_along_axis(out, order, held < k, axis=1)
        return out & (self.count > 0)

    def possible(self, distance: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether a group can hold a scan within ``bound`` of a query."""
        nearest = np.where(self.count > 0, distance, np.inf).min(axis=1)
        least = np.maximum(np.maximum(distance - self.far, self.near - distance), (distance - nearest[:, None]) / 2)
        return (least <= bound[:, None] * (1 + 1e-9) + 1e-6) & (self.count > 0)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few enough rows to stand beside all pivots."""
    return (b.slice(start, _ROWS) for b in batches for start in range(0, b.num_rows, _ROWS))


_SCAN = "id long, aps array<string>, xs array<bigint>"


def _meet(visits: DataFrame, scans: DataFrame, count: np.ndarray, k: int) -> DataFrame:
    """(query_id, neighbor_id, d2): the k nearest scans of each visited group, or of each
    part of a large one. ``visits``: (query scan, pivot), ``scans``: (scan, pivot)."""
    callers = {r["pivot"]: r["n"] for r in visits.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
    sides = [(p, int(-(-count[p] // TILE_SCANS)), int(-(-n // TILE_SCANS))) for p, n in callers.items()]
    grid = visits.sparkSession.createDataFrame(sides, "pivot int, tiles int, blocks int")
    part, every = (lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    q = visits.join(grid, "pivot").withColumn("block", part("blocks")).withColumn("tile", every("tiles")).drop("tiles", "blocks")
    t = scans.join(grid, "pivot").withColumn("tile", part("tiles")).withColumn("block", every("blocks")).drop("tiles", "blocks")
    return q.groupBy("pivot", "tile", "block").cogroup(t.groupBy("pivot", "tile", "block")).applyInArrow(
        lambda left, right: nearest_in_tile(left, right, k), "query_id long, neighbor_id long, d2 long")


def _best(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("d2", "neighbor_id")
    return near.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).select("query_id", "neighbor_id", "d2", "rn")


def indexed_neighbors(queries: DataFrame, scans: DataFrame, n_scans: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(neighbours as from ``knn_neighbors``, the visits (id, pivot) paid), by the pivot index.
    ``queries`` and ``scans`` are vectors (id, aps, xs)."""
    sc = ship(scans.sparkSession).sparkContext
    scans, queries = materialize(scans, "knn-scans"), materialize(queries, "knn-queries")
    wanted = min(MOST_PIVOTS, math.ceil(n_scans / PIVOT_SCANS))
    drawn = scans.orderBy(F.xxhash64("id"), "id").limit(wanted)  # a bounded number of rows
    pivots = Pivots.of(drawn.toArrow())
    shared = sc.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            d = shared.value.distances(b)
            own = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own])],
                                             ["id", "aps", "xs", "pivot", "radius"])

    dealt = materialize(scans.mapInArrow(assign, f"{_SCAN}, pivot int, radius double"), "knn-groups")
    groups = dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("near"), F.max("radius").alias("far")).collect()
    pivots.count, pivots.near, pivots.far = np.zeros(len(pivots.norms), np.int64), np.zeros(len(pivots.norms)), np.zeros(len(pivots.norms))
    for g in groups:
        pivots.count[g["pivot"]], pivots.near[g["pivot"]], pivots.far[g["pivot"]] = g["n"], g["near"], g["far"]
    known = sc.broadcast(pivots)
    dealt = dealt.drop("radius")

    def visits(again: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = known.value
            for b in _small(batches):
                d = index.distances(b)
                meets = index.first(d, k)
                if again:
                    meets = index.possible(d, np.sqrt(b.column("bound").to_numpy())) & ~meets
                row, pivot = np.nonzero(meets)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in b.columns[:3]), pa.array(pivot.astype(np.int32))],
                                                 ["id", "aps", "xs", "pivot"])
        return run

    schema = f"{_SCAN}, pivot int"
    first = materialize(queries.mapInArrow(visits(False), schema), "knn-first")
    found = materialize(_best(_meet(first, dealt, pivots.count, k), k), "knn-found")
    bound = found.groupBy(F.col("query_id").alias("id")).agg(F.max("d2").cast("double").alias("bound"))
    second = materialize(queries.join(bound, "id").select("id", "aps", "xs", "bound").mapInArrow(visits(True), schema), "knn-second")
    more = _meet(second, dealt, pivots.count, k)
    paid = first.select("id", "pivot").unionByName(second.select("id", "pivot"))
    return _best(found.drop("rn").unionByName(more), k), paid


def knn_neighbors(queries: DataFrame, train: DataFrame, reading: DataFrame, k: int = K,
                  fill: int = FILL_DBM) -> DataFrame:
    """(query_id, neighbor_id, d2, rn) for the k nearest training scans of every
    query scan, ordered by (d2, neighbor_id). ``queries`` and ``train`` are scan
    tables with ``obs_id``, each id taken once."""
    queries, train = queries.select("obs_id").distinct(), train.select("obs_id").distinct()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n_train = train.count()
    if n_train > max(cores, 1) * TILE_SCANS:
        return indexed_neighbors(_vectors(queries, reading, fill), _vectors(train, reading, fill), n_train, k)[0]
    tiles, blocks = _parts(n_train, cores), _parts(queries.count(), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = _vectors(queries, reading, fill).withColumn("block", part(blocks)).withColumn("tile", every(tiles))
    t = _vectors(train, reading, fill).withColumn("tile", part(tiles)).withColumn("block", every(blocks))
    near = q.groupBy("tile", "block").cogroup(t.groupBy("tile", "block")).applyInArrow(
        lambda left, right: nearest_in_tile(left, right, k), "query_id long, neighbor_id long, d2 long")
    return _best(near, k)


def knn_predict(neighbors: DataFrame, train_labels: DataFrame, classes=(), numbers=()) -> DataFrame:
    """(obs_id, <target>...): for every query the uniform vote of its neighbours
    for each of ``classes`` (ties go to the smallest label) and their mean for
    each of ``numbers``; one join and one aggregate for all targets."""
    lab = train_labels.select(F.col("obs_id").alias("neighbor_id"), *classes, *[F.col(c).cast("double").alias(c) for c in numbers])
    return (neighbors.join(lab, "neighbor_id").groupBy(F.col("query_id").alias("obs_id"))
            .agg(*[F.mode(c, True).alias(c) for c in classes], *[F.avg(c).alias(c) for c in numbers]))


def knn_classify(neighbors: DataFrame, train_labels: DataFrame, label: str) -> DataFrame:
    """(obs_id, prediction): the vote for one label."""
    return knn_predict(neighbors, train_labels, classes=[label]).withColumnRenamed(label, "prediction")


def knn_regress(neighbors: DataFrame, train_labels: DataFrame, label: str) -> DataFrame:
    """(obs_id, prediction DOUBLE): the mean of one value."""
    return knn_predict(neighbors, train_labels, numbers=[label]).withColumnRenamed(label, "prediction")
