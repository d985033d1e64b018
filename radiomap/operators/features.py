"""Feature vectors for Spark ML from the long readings, scaling and PCA.

A scan becomes a sparse vector over the AP index with x = rssi - fill (0 = not
heard). The entries are gathered with built-in functions, bounded by the APs one
scan hears, and written in the storage form of an ML vector (type, size,
indices, values); reading that table back with a vector column gives
``SparseVector`` rows without a UDF, and cuts the lineage for the many jobs of a
model fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.feature import StandardScaler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiomap.functions.signal import FILL_DBM, shifted
from radiomap.operators.clean import with_dataset
from radiomap.operators.indexing import row_index
from radiomap.session import shared_dir, ship

MATRIX_ROWS = 4096  # rows of a summed matrix that travel together


def ap_index(aps: DataFrame) -> DataFrame:
    """(ap_id, idx) with idx = 0..n-1 in AP name order; distributed numbering."""
    distinct = aps.select("ap_id").distinct()
    return row_index(distinct, ["ap_id"], name="idx", start=0).select(
        "ap_id", F.col("idx").cast("int").alias("idx"))


def as_vectors(rows: DataFrame, n_features: int, entries: str = "_entries", out: str = "features") -> DataFrame:
    """``rows`` with the sorted (idx, x) array ``entries`` as a sparse vector ``out``;
    a null x is 0."""
    e = F.coalesce(F.col(entries), F.array().cast("array<struct<idx:int,x:double>>"))
    others = [c for c in rows.columns if c != entries]
    stored = rows.withColumn(entries, e).select(*others, F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(n_features).alias("size"),
        F.col(f"{entries}.idx").alias("indices"),
        F.transform(f"{entries}.x", lambda x: F.coalesce(x, F.lit(0.0))).alias("values")).alias(out))
    spark = rows.sparkSession
    path = shared_dir(spark, "vectors")
    stored.write.mode("overwrite").parquet(path)
    fields = [f for f in rows.schema.fields if f.name != entries]
    return spark.read.schema(T.StructType([*fields, T.StructField(out, VectorUDT())])).parquet(path)


def _entries(scans: DataFrame, reading: DataFrame, index: DataFrame, fill: int) -> DataFrame:
    """``scans`` with their (idx, x) entries; a repeated reading counts by its
    strongest value, readings of APs outside the index are ignored."""
    x = reading.join(index, "ap_id").groupBy("obs_id", "idx").agg(F.max(shifted(F.col("rssi"), fill)).cast("double").alias("x"))
    per = x.groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("_entries"))
    return scans.join(per, "obs_id", "left")


def feature_vectors(scans: DataFrame, reading: DataFrame, index: DataFrame, n_features: int,
                    fill: int = FILL_DBM, out: str = "features") -> DataFrame:
    """(obs_id, features) for every scan in ``scans``."""
    return as_vectors(_entries(scans.select("obs_id"), reading, index, fill), n_features, out=out)


def vector_entries(vectors: DataFrame, features: str = "features") -> DataFrame:
    """(obs_id, idx, x) of the non-zero entries of vectors, taken from what a vector
    stores: the work follows the entries, not the length of the vectors."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, x = _entries_of(b.column(1))
            use = x != 0
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[use])), pa.array(at[use].astype(np.int32)), pa.array(x[use])],
                                             ["obs_id", "idx", "x"])

    kind = vectors.schema["obs_id"].dataType.simpleString()
    return vectors.select("obs_id", features).mapInArrow(run, f"obs_id {kind}, idx int, x double")


def labeled_vectors(obs: DataFrame, scans: DataFrame, reading: DataFrame, index: DataFrame,
                    n_features: int, labels=("building_id", "floor", "longitude", "latitude")) -> DataFrame:
    """Feature vectors with label columns (as doubles) attached; a scan that
    ``scans`` repeats (a draw with replacement) is repeated."""
    lab = obs.select("obs_id", *[F.col(c).cast("double").alias(c) for c in labels])
    rows = scans.select("obs_id").join(lab, "obs_id")
    return as_vectors(_entries(rows, reading, index, FILL_DBM), n_features).select("obs_id", "features", *labels)


def scaler_stats(obs: DataFrame, reading: DataFrame, dataset: str = "train", fill: int = FILL_DBM,
                 digits: int | None = 6) -> DataFrame:
    """Per AP mean and population standard deviation of the filled signal over
    the scans of ``dataset`` (not-heard = 0 after the shift), as the standard
    scaler of the survey fits them. Sums over heard readings only; the scan
    count supplies the zeros."""
    n = obs.filter(F.col("dataset") == dataset).count()  # one number to the driver
    x = shifted(F.col("rssi"), fill)
    sums = (with_dataset(reading, obs).filter(F.col("dataset") == dataset).groupBy("ap_id")
            .agg(F.sum(x).cast("double").alias("_s1"), F.sum(x * x).cast("double").alias("_s2")))
    mean = F.col("_s1") / F.lit(float(n))
    var = F.greatest(F.col("_s2") / F.lit(float(n)) - mean * mean, F.lit(0.0))
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return sums.select("ap_id", r(mean).alias("mean"), r(F.sqrt(var)).alias("std"))


def standard_scaler(input_col: str = "features", output_col: str = "scaled") -> StandardScaler:
    """To unit variance. Nothing is centred, so sparse vectors stay sparse."""
    return StandardScaler(inputCol=input_col, outputCol=output_col, withMean=False, withStd=True)


def _entries_of(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of the stored entries of a column of vectors, sparse or dense."""
    values, size = column.field("values"), pa.compute.list_value_length(column.field("values")).to_numpy(zero_copy_only=False).astype(np.int64)
    row, x = np.repeat(np.arange(len(size)), size), values.flatten().to_numpy()
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    sparse = np.repeat(column.field("type").to_numpy(zero_copy_only=False) == 0, size)
    place[sparse] = column.field("indices").flatten().to_numpy()
    return row, place, x


def _added(vectors: DataFrame, input_col: str, rows: int, width: int, part) -> np.ndarray:
    """The sum over all batches of ``part(entries, rows of the batch)``, a matrix of so many
    rows and columns, which travels in runs of ``MATRIX_ROWS`` rows and is added by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for b in batches:
            total += part(*_entries_of(b.column(0)), b.num_rows)
        starts = range(0, rows, MATRIX_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([total[s:s + MATRIX_ROWS].tobytes() for s in starts], pa.binary())], ["k", "m"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in table["m"].to_pylist())
        return pa.table({"k": table["k"][:1], "m": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((rows, width))
    sums = vectors.select(input_col).mapInArrow(run, "k long, m binary").groupBy("k").applyInArrow(add, "k long, m binary")
    for k, m in sums.toLocalIterator():
        out[k:k + MATRIX_ROWS] = np.frombuffer(m).reshape(-1, width)
    return out


def pca_explained(vectors: DataFrame, k: int = 3, input_col: str = "features", block: int = 8, steps: int = 12) -> DataFrame:
    """(component, explained_variance): the shares of the k largest principal components of
    the standardised vectors.

    By block Lanczos: each step is one pass that multiplies the covariance with a block of
    vectors by sums over sparse entries; the means enter as a correction of rank one, so
    nothing is centred, and neither the vectors nor an AP x AP matrix reach the driver, only
    APs x block numbers a step. With ``block * steps`` at or above the number of APs the
    shares are exact; below it the leading ones converge first. Constant columns have no
    variance; without any variance the shares are 0."""
    spark = vectors.sparkSession
    first = vectors.select(input_col).first()
    p = first[0].size if first else 0
    k = min(k, p)
    ship(spark)

    def moments(row: np.ndarray, at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(at, x, p), np.bincount(at, x * x, p), np.full(p, float(n))], axis=1)

    sums = _added(vectors, input_col, p, 3, moments)
    n = sums[0, 2] if p else 0.0
    mean = sums[:, 0] / max(n, 1.0)
    variance = np.maximum(sums[:, 1] - n * mean * mean, 0.0) / max(n - 1.0, 1.0)
    variance[variance <= 1e-12 * np.maximum(sums[:, 1], 1e-300)] = 0.0
    scale = np.where(variance > 0, 1 / np.sqrt(np.where(variance > 0, variance, 1.0)), 0.0)

    def times(q: np.ndarray) -> np.ndarray:
        """The covariance of the standardised columns times q."""
        scaled = scale[:, None] * q

        def product(row: np.ndarray, at: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
            out = np.empty(q.shape)
            for c in range(q.shape[1]):
                y = np.bincount(row, x * scaled[at, c], rows)
                out[:, c] = np.bincount(at, x * y[row], p)
            return out

        whole = _added(vectors, input_col, p, q.shape[1], product)
        return scale[:, None] * (whole - n * np.outer(mean, mean @ scaled)) / max(n - 1.0, 1.0)

    rank = int((variance > 0).sum())
    shares = np.zeros(k)
    if rank:
        q = np.linalg.qr(np.where(scale > 0, 1.0, 0.0)[:, None] * np.random.default_rng(0).standard_normal((p, min(block, rank))))[0]
        basis, image = np.empty((p, 0)), np.empty((p, 0))
        for _ in range(steps):
            g = times(q)
            basis, image = np.hstack([basis, q]), np.hstack([image, g])
            for _ in range(2):  # orthogonal to all before, twice for rounding
                g = g - basis @ (basis.T @ g)
            u, size, _ = np.linalg.svd(g, full_matrices=False)
            q = u[:, size > 1e-9 * rank][:, :rank - basis.shape[1]]
            if not q.shape[1]:
                break
        inner = basis.T @ image
        values = np.sort(np.linalg.eigvalsh((inner + inner.T) / 2))[::-1][:k]
        shares[:len(values)] = np.maximum(values, 0) / rank
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(shares)], "component int, explained_variance double")
