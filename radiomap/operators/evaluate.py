"""Scoring tables and metrics, computed as grouped aggregates.

A scored table is long: (obs_id, split, target, actual, predicted). Metrics
group by (target, split), so one pass evaluates every model and test set. The
confusion table has at most classes^2 rows per group; kappa is computed from
it with joins of per-class margins, never on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = ("target", "split")


def _r(c, digits):
    return F.round(c, digits) if digits is not None else c


def scored_table(predictions: DataFrame, truth: DataFrame, target: str, splits: DataFrame | None = None,
                 digits: int | None = 6) -> DataFrame:
    """Long scored rows for one target from (obs_id, prediction) and the truth
    table; ``splits`` (obs_id, split) assigns each row to its test sets."""
    t = truth.select("obs_id", F.col(target).cast("double").alias("actual"))
    p = predictions.select("obs_id", _r(F.col("prediction").cast("double"), digits).alias("predicted"))
    s = splits if splits is not None else predictions.select("obs_id", F.lit("test").alias("split"))
    return (s.join(p, "obs_id").join(t, "obs_id")
            .select("obs_id", "split", F.lit(target).alias("target"), "actual", "predicted"))


def scored_wide(predictions: DataFrame, truth: DataFrame, targets, splits: DataFrame,
                digits: int | None = 6) -> DataFrame:
    """Long scored rows for several targets at once, from predictions (obs_id,
    <target>...): one join to the truth and the test sets for all of them."""
    p = predictions.select("obs_id", *[_r(F.col(t).cast("double"), digits).alias(f"_p_{t}") for t in targets])
    t = truth.select("obs_id", *[F.col(c).cast("double").alias(f"_a_{c}") for c in targets])
    rows = F.array(*[F.struct(F.lit(c).alias("target"), F.col(f"_a_{c}").alias("actual"), F.col(f"_p_{c}").alias("predicted"))
                     for c in targets])
    return splits.join(p, "obs_id").join(t, "obs_id").select("obs_id", "split", F.inline(rows))


def confusion_matrix(scored: DataFrame, by=GROUP) -> DataFrame:
    """(by..., actual, predicted, n) — the long contingency table."""
    return (scored.groupBy(*by, F.col("actual").cast("int").alias("actual"),
                           F.col("predicted").cast("int").alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion_wide(scored: DataFrame, classes, by=()) -> DataFrame:
    """Rows = actual, one column per predicted class (``crosstab`` shape)."""
    return (scored.groupBy(*by, F.col("actual").cast("int").alias("actual"))
            .pivot("predicted", [float(c) for c in classes]).count().fillna(0))


def accuracy(scored: DataFrame, by=GROUP, digits: int | None = 6) -> DataFrame:
    hit = F.when(F.col("actual") == F.col("predicted"), 1.0).otherwise(0.0)
    return scored.groupBy(*by).agg(_r(F.avg(hit), digits).alias("accuracy"))


def kappa_from_confusion(cm: DataFrame, by=GROUP, digits: int | None = 6) -> DataFrame:
    """Cohen's kappa (unweighted) per group from (by..., actual, predicted, n).
    NULL when chance agreement is 1 (a single class on both sides)."""
    by = list(by)
    tot = cm.groupBy(*by).agg(F.sum("n").cast("double").alias("_N"),
                              F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
                              .cast("double").alias("_diag"))
    rows = cm.groupBy(*by, F.col("actual").alias("_c")).agg(F.sum("n").alias("_r"))
    cols = cm.groupBy(*by, F.col("predicted").alias("_c")).agg(F.sum("n").alias("_p"))
    chance = (rows.join(cols, by + ["_c"]).groupBy(*by)
              .agg(F.sum(F.col("_r").cast("double") * F.col("_p").cast("double")).alias("_s")))
    j = tot.join(chance, by, "left")
    po = F.col("_diag") / F.col("_N")
    pe = F.coalesce(F.col("_s"), F.lit(0.0)) / (F.col("_N") * F.col("_N"))
    kappa = F.when(pe < 1.0, (po - pe) / (F.lit(1.0) - pe))
    return j.select(*by, _r(kappa, digits).alias("kappa"))


def cohen_kappa(scored: DataFrame, by=GROUP, digits: int | None = 6) -> DataFrame:
    return kappa_from_confusion(confusion_matrix(scored, by), by, digits)


def mae(scored: DataFrame, by=GROUP, digits: int | None = 6) -> DataFrame:
    return scored.groupBy(*by).agg(_r(F.avg(F.abs(F.col("predicted") - F.col("actual"))), digits).alias("mae"))


def residuals(scored: DataFrame, digits: int | None = 6) -> DataFrame:
    err = F.col("predicted") - F.col("actual")
    return scored.select("obs_id", "split", "target", _r(err, digits).alias("error"),
                         _r(F.abs(err), digits).alias("abs_error"))


def zero_position(df: DataFrame, column: str, by=(), digits: int | None = 6) -> DataFrame:
    """Where 0 falls in the range of ``column``: abs(0 - min / (max - min)),
    used to centre a diverging colour scale; one aggregate, by group if asked."""
    lo, hi = F.min(column), F.max(column)
    return df.groupBy(*by).agg(_r(F.abs(F.lit(0.0) - lo / (hi - lo)), digits).alias("zero_pos"))


def evaluation_report(scored: DataFrame, class_targets, reg_targets, digits: int | None = 6) -> DataFrame:
    """(target, split, metric, value): accuracy and kappa for classes, MAE for
    coordinates, for every test set in ``split``."""
    cls = scored.filter(F.col("target").isin(*class_targets))
    reg = scored.filter(F.col("target").isin(*reg_targets))
    acc = accuracy(cls, digits=digits).select(*GROUP, F.lit("accuracy").alias("metric"),
                                              F.col("accuracy").alias("value"))
    kap = cohen_kappa(cls, digits=digits).select(*GROUP, F.lit("kappa").alias("metric"),
                                                 F.col("kappa").alias("value"))
    err = mae(reg, digits=digits).select(*GROUP, F.lit("mae").alias("metric"), F.col("mae").alias("value"))
    return acc.unionByName(kap).unionByName(err)


def residual_surface(scored: DataFrame, obs: DataFrame, targets, digits: int | None = 6) -> DataFrame:
    """(obs_id, split, target, longitude, latitude, error) for plotting the error
    over the map, for each of ``targets`` and every test set."""
    s = scored.filter(F.col("target").isin(*targets))
    return (s.join(obs.select("obs_id", "longitude", "latitude"), "obs_id")
            .select("obs_id", "split", "target", "longitude", "latitude",
                    _r(F.col("predicted") - F.col("actual"), digits).alias("error")))
