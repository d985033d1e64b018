"""Reproducible sampling: exact n per group, exact n overall, fractions,
Poisson bootstrap and hash splits.

Every draw orders rows by ``hash_key(seed, salt, id)``, so a sample does not
change when the input is repartitioned or a task reruns after an executor
loss, and DuckDB can reproduce it row for row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from radiomap.functions.hashing import hash_key, hash_uniform
from radiomap.operators.indexing import row_index
from radiomap.session import materialize

SEED = 42  # fixed value: the survey's default seed
# Up to this n the exact overall sample is a TakeOrdered over the narrowed
# superset (about n rows reach its merge task); above it the distributed row
# index is used.
TAKE_ORDERED_MAX_N = 100_000
BINS_PER_HALVING = 8


def _keys(seed: int, salt: str | None, id_col: str):
    return (F.lit(salt), id_col) if salt else (id_col,)


def draw_order(seed: int, id_col: str = "obs_id", salt: str | None = None):
    return hash_key(seed, *_keys(seed, salt, id_col))


def draw_uniform(seed: int, id_col: str = "obs_id", salt: str | None = None):
    return hash_uniform(seed, *_keys(seed, salt, id_col))


def stratified_sample(df: DataFrame, by, n: int, seed: int = SEED, id_col: str = "obs_id",
                      salt: str | None = None) -> DataFrame:
    """Exactly ``min(n, group size)`` rows from each group of ``by``.

    The draw order refines the hash-uniform, so a histogram of the uniform by group
    shows how far the first n rows reach. Its bins are equally wide in the logarithm,
    ``BINS_PER_HALVING`` for each halving, so the bin in which the n-th row falls adds
    about a tenth to n however large the group is. Histograms of partitions add up to
    those of the table, at most ``52 * BINS_PER_HALVING`` numbers a group. ``df`` is
    derived once: the rows are written with their bins, read once for the histogram and
    once for the rows up to the cut-offs, and only these are ranked."""
    by = list(by)
    cols = df.columns
    u = draw_uniform(seed, id_col, salt)
    step = F.when(u <= 0, F.lit(-(1 << 30))).otherwise(F.floor(F.log2(u) * BINS_PER_HALVING)).cast("int")
    binned = materialize(df.withColumn("_bin", step), "stratified")
    counts = binned.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = (counts.withColumn("_before", before).filter(F.col("_before") < n)
            .groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(F.max("_bin").alias("_cut")))
    match = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    kept = binned.join(cuts, [*match, F.col("_bin") <= F.col("_cut")])
    w = Window.partitionBy(*by).orderBy(draw_order(seed, id_col, salt), F.col(id_col))
    return kept.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).select(*cols)


def sample_n(df: DataFrame, n: int, seed: int = SEED, id_col: str = "obs_id",
             salt: str | None = None) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement: the n smallest by
    ``draw_order``.

    Rows are first narrowed to those whose hash-uniform falls under a cutoff a
    little above n / rows (the uniform is the draw order's leading 52 bits, so
    the n smallest always lie under the cutoff whenever at least n rows do).
    The exact n are then taken from that superset of about n rows: a
    TakeOrdered for moderate n (its single merge task sees ~n rows, not n per
    input partition), the distributed row index above that. If the cutoff
    ever keeps fewer than n rows, the whole input is ranked instead."""
    h = draw_order(seed, id_col, salt)
    total = df.count()  # one number to the driver
    if n >= total:
        return df
    cutoff = min(1.0, (n * 1.1 + 100.0) / total)
    cols = df.columns
    narrowed = df.filter(draw_uniform(seed, id_col, salt) < F.lit(cutoff))
    if cutoff < 1.0 and narrowed.count() < n:
        narrowed = df
    if n <= TAKE_ORDERED_MAX_N:
        return narrowed.withColumn("_h", h).orderBy("_h", id_col).limit(n).select(*cols)
    return (row_index(narrowed.withColumn("_h", h), ["_h", id_col], name="_rn")
            .filter(F.col("_rn") <= n).select(*cols))


def round_half_even(x: float) -> int:
    """pandas/Python ``round``: halves go to the even neighbour."""
    return int(round(x))


def sample_fraction(df: DataFrame, frac: float, seed: int = SEED, id_col: str = "obs_id",
                    salt: str | None = None) -> DataFrame:
    """Exactly ``round(frac * rows)`` rows (one count, then :func:`sample_n`)."""
    n = round_half_even(frac * df.count())
    return sample_n(df, n, seed, id_col, salt) if n > 0 else df.limit(0)


def poisson_cdf_steps(mean: float, tol: float = 1e-16) -> list[float]:
    """P(X <= j) for j = 0, 1, ... until the tail is below ``tol``."""
    steps, p, total, j = [], math.exp(-mean), 0.0, 0
    while True:
        total += p
        steps.append(total)
        if 1.0 - total < tol or j > 200:
            return steps
        j += 1
        p *= mean / j


def poisson_copies(u, mean: float):
    """Copies a row gets in a Poisson(mean) bootstrap, from a uniform ``u``."""
    return sum((F.when(u >= F.lit(c), 1).otherwise(0) for c in poisson_cdf_steps(mean)), F.lit(0))


def bootstrap(df: DataFrame, frac: float, seed: int = SEED, id_col: str = "obs_id",
              salt: str | None = None) -> DataFrame:
    """Sampling with replacement: each row appears Poisson(frac) times, with
    ``copy_no`` = 1..copies. The expected size is ``frac * rows`` (not exact);
    a 0.5 draw leaves about e^-0.5 = 61 % of rows out."""
    copies = poisson_copies(draw_uniform(seed, id_col, salt), frac)
    return (df.withColumn("_copies", copies).filter(F.col("_copies") > 0)
            .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .drop("_copies"))


def bootstrap_exact(df: DataFrame, frac: float, seed: int = SEED, id_col: str = "obs_id",
                    salt: str | None = None) -> DataFrame:
    """Exactly ``round(frac * rows)`` draws with replacement, each row as often as it is
    drawn, with ``copy_no`` = 1..copies.

    Draw i takes the row at a position, by ``id_col``, from a hash of i, so the copies of
    the rows are multinomial. Positions meet the distributed row index in one join; the
    draws of a position are counted before. Ids must be unique."""
    rows = df.count()  # one number to the driver
    draws = round_half_even(frac * rows)
    u = hash_uniform(seed, *([F.lit(salt)] if salt else []), "id")
    places = df.sparkSession.range(draws).select((F.floor(u * F.lit(rows)) + 1).cast("bigint").alias("_place"))
    copies = places.groupBy("_place").agg(F.count(F.lit(1)).alias("_copies"))
    indexed = row_index(df, [id_col], name="_place")
    return (indexed.join(copies, "_place").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
            .select(*df.columns, "copy_no"))


def random_split(df: DataFrame, train_frac: float = 0.75, seed: int = SEED, id_col: str = "obs_id",
                 salt: str | None = None, names=("train", "test")) -> DataFrame:
    """Bernoulli split by hash threshold; adds ``split``. Sizes are expected,
    not exact (use :func:`sample_n` for an exact count)."""
    u = draw_uniform(seed, id_col, salt)
    return df.withColumn("split", F.when(u < F.lit(train_frac), names[0]).otherwise(names[1]))
