"""Composite train/test splits of the labeled surveys.

Each returns (obs_id, split[, copy_no]) in long form; a scan can be in several
splits (e.g. ``test`` and ``train_final``). ``hard_test`` is the part of
``test`` drawn from the validation survey only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiomap.operators.reshape import union_surveys
from radiomap.session import materialize
from radiomap.operators.sampling import SEED, bootstrap, sample_fraction, sample_n, stratified_sample

GROUP = ("building_id", "floor")

# Fixed values of the surveyed splits: per-group sample sizes, test fractions
# and seeds, in the order the splits use them.
PER_GROUP_5_1, VAL_PER_GROUP_5_1, TEST_FRAC_5_1 = 400, 20, 0.25
PER_GROUP_ALL, VAL_N_ALL = 400, 250
PER_GROUP_HALF, VAL_FRAC_HALF, REST_FRAC_HALF, VAL_SEED_HALF, REST_SEED_HALF = 900, 0.5, 0.3, 32, 33
PER_GROUP_SAMPLE2 = 500


def _tag(df: DataFrame, name: str) -> DataFrame:
    return df.select("obs_id", F.lit(name).alias("split"))


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("obs_id"), "obs_id", "left_anti")


def _labeled(obs: DataFrame, dataset: str) -> DataFrame:
    return obs.filter(F.col("dataset") == dataset).select("obs_id", *GROUP)


def split_5_1(obs: DataFrame, per_group: int = PER_GROUP_5_1, val_per_group: int = VAL_PER_GROUP_5_1,
              test_frac: float = TEST_FRAC_5_1, seed: int = SEED) -> DataFrame:
    """``5_1_train_val``: n per group from train plus validation, 25 % of the
    training sample and 20 per group of validation to test, the rest to train;
    ``train_final`` = all validation + the training sample."""
    tr, val = _labeled(obs, "train"), _labeled(obs, "val")
    test_val = stratified_sample(val, GROUP, val_per_group, seed, salt="test_val")
    train_val = _minus(val, test_val)
    # Bounded by per_group x groups rows: written once to the checkpoint folder
    # so counting it and the three uses below do not redo the draw.
    tr_samp = materialize(stratified_sample(tr, GROUP, per_group, seed, salt="tr_samp"), "tr_samp")
    test_tr = sample_fraction(tr_samp, test_frac, seed, salt="test_tr")
    train_tr = _minus(tr_samp, test_tr)
    return union_surveys(
        _tag(train_val, "train"), _tag(train_tr, "train"),
        _tag(test_val, "test"), _tag(test_tr, "test"), _tag(test_val, "hard_test"),
        _tag(val, "train_final"), _tag(tr_samp, "train_final"))


def split_all_train(obs: DataFrame, per_group: int = PER_GROUP_ALL, val_n: int = VAL_N_ALL,
                    seed: int = SEED) -> DataFrame:
    """``all_train``: test = n per group of train + ``val_n`` validation scans;
    train = every other labeled scan; ``train_final`` = all labeled scans."""
    tr, val = _labeled(obs, "train"), _labeled(obs, "val")
    test_val = sample_n(val, val_n, seed, salt="test_val")
    test_tr = stratified_sample(tr, GROUP, per_group, seed, salt="test_tr")
    test = union_surveys(test_tr, test_val)
    train = _minus(union_surveys(tr, val), test)
    return union_surveys(_tag(train, "train"), _tag(test, "test"), _tag(test_val, "hard_test"),
                         _tag(tr, "train_final"), _tag(val, "train_final"))


def split_half_val(obs: DataFrame, per_group: int = PER_GROUP_HALF, val_frac: float = VAL_FRAC_HALF,
                   rest_frac: float = REST_FRAC_HALF, seed: int = SEED, val_seed: int = VAL_SEED_HALF,
                   rest_seed: int = REST_SEED_HALF) -> DataFrame:
    """Half the validation survey drawn with replacement joins n per group of
    training for ``train``; the validation rows not drawn plus a 30 % draw with
    replacement of the unused training rows form ``test``. Output carries
    ``copy_no`` (1 for rows drawn once or without replacement)."""
    tr, val = _labeled(obs, "train"), _labeled(obs, "val")
    val1 = bootstrap(val, val_frac, val_seed, salt="val_half")
    val2 = _minus(val, val1)
    sample_train = stratified_sample(tr, GROUP, per_group, seed, salt="sample_train")
    rest = bootstrap(_minus(tr, sample_train), rest_frac, rest_seed, salt="rest")
    one = F.lit(1).alias("copy_no")
    return union_surveys(
        sample_train.select("obs_id", F.lit("train").alias("split"), one),
        val1.select("obs_id", F.lit("train").alias("split"), F.col("copy_no").cast("int").alias("copy_no")),
        rest.select("obs_id", F.lit("test").alias("split"), F.col("copy_no").cast("int").alias("copy_no")),
        val2.select("obs_id", F.lit("test").alias("split"), one))


def split_sample2(obs: DataFrame, per_group: int = PER_GROUP_SAMPLE2, seed: int = SEED) -> DataFrame:
    """n per group of training plus the whole validation survey."""
    tr, val = _labeled(obs, "train"), _labeled(obs, "val")
    return union_surveys(_tag(stratified_sample(tr, GROUP, per_group, seed, salt="sample2"), "train"),
                         _tag(val, "train"))


def holdout_complement(df: DataFrame, holdout: DataFrame) -> DataFrame:
    """Rows of ``df`` not in ``holdout`` (by obs_id): ``A.drop(B.index)``."""
    return _minus(df, holdout)
