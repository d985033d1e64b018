"""Named entry points for the survey's public helpers, on Spark DataFrames.

``set_y`` (features + chosen target), ``rfc_pred`` / ``acc_report`` (confusion
matrix, accuracy, kappa), ``mae_report``, ``find_error`` (residuals),
``xgb_fit`` (boosted regressor) and ``lat_long_reg`` (search + early stopping +
refit + predict) expressed with the operators of this package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiomap.operators import evaluate, models, search
from radiomap.operators.boosted import BoostedModel, StagedBooster


def set_y(df: DataFrame, target: str, features: str = "features") -> DataFrame:
    """(obs_id, features, label) with the chosen target as ``label``."""
    return df.select("obs_id", features, F.col(target).cast("double").alias("label"))


def rfc_pred(model, test: DataFrame, target: str, split: str = "test") -> dict[str, DataFrame]:
    """Score a classifier on ``test`` and report confusion matrix, accuracy, kappa."""
    p = models.score(model, test)
    scored = evaluate.scored_table(p, test.select("obs_id", target), target,
                                   test.select("obs_id", F.lit(split).alias("split")), digits=None)
    return acc_report(scored)


def acc_report(scored: DataFrame) -> dict[str, DataFrame]:
    return {"confusion": evaluate.confusion_matrix(scored), "accuracy": evaluate.accuracy(scored),
            "kappa": evaluate.cohen_kappa(scored)}


def mae_report(scored: DataFrame) -> DataFrame:
    return evaluate.mae(scored)


def find_error(scored: DataFrame) -> DataFrame:
    return evaluate.residuals(scored)


def xgb_fit(train: DataFrame, watch: DataFrame, target: str, **params) -> BoostedModel:
    """Boosted regression (squared loss) with early stopping on ``watch``;
    ``params`` are those of :class:`StagedBooster`."""
    return StagedBooster(target, watch, **params).fit(train)


def lat_long_reg(train: DataFrame, watch: DataFrame, final_train: DataFrame, unlabeled: DataFrame,
                 target: str, grid: dict, n_iter: int = 8, folds: int = 5) -> dict[str, DataFrame]:
    """Randomized search (MAE) with early stopping on ``watch``, refit with all
    parameters of the best draw on ``final_train``, predictions for ``unlabeled``."""
    found = search.tune_boosted(grid, train, watch, target, n_iter, folds)
    final = StagedBooster(target, watch).copy(found.params).fit(final_train)
    return {"search": found.table, "curve": search.curve_table(train.sparkSession, found.model.curve),
            "predictions": models.score(final, unlabeled, f"{target}_pred")}
