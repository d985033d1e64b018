"""Cleaning: heard counts, empty scans, unheard and constant APs.

All operators work on the long form. "Not heard" is an absent row, so counts
that the wide form gets from nulls are (dataset size - heard count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiomap.functions.signal import FILL_DBM, OUTLIER_DBM, STRONG_DBM

# Fixed vocabulary of survey tags: training survey, validation survey, and the
# unlabeled set to predict.
DATASETS = ("train", "val", "test")


def tag_dataset(df: DataFrame, name: str) -> DataFrame:
    """Mark every row of one survey with its source tag."""
    return df.withColumn("dataset", F.lit(name))


def select_by_prefix(df: DataFrame, prefix: str = "WAP", keep=("obs_id",)) -> DataFrame:
    """Keep the id columns and every column whose name starts with ``prefix``."""
    return df.select(*keep, *[c for c in df.columns if c.startswith(prefix) and c not in keep])


def select_by_position(df: DataFrame, start: int, stop: int | None = None, keep=()) -> DataFrame:
    """Columns ``start:stop`` by position (plus ``keep`` columns first); the
    position is read from the schema, so it is fixed once the plan is built."""
    cols = [c for c in df.columns[start:stop] if c not in keep]
    return df.select(*keep, *cols)


def with_dataset(reading: DataFrame, obs: DataFrame, *cols: str) -> DataFrame:
    """Attach the scan's dataset tag (and any other scan columns) to each reading."""
    extra = [c for c in cols if c != "dataset"]
    return reading.join(obs.select("obs_id", "dataset", *extra), "obs_id")


def signal_count(obs: DataFrame, reading: DataFrame) -> DataFrame:
    """Heard APs per scan (``sig_count``); scans with no reading get 0."""
    counts = reading.groupBy("obs_id").agg(F.count("rssi").alias("sig_count"))
    return (obs.select("obs_id").join(counts, "obs_id", "left")
            .select("obs_id", F.coalesce("sig_count", F.lit(0)).cast("bigint").alias("sig_count")))


def drop_empty_scans(obs: DataFrame, reading: DataFrame) -> DataFrame:
    """Scans with at least one heard AP (``sig_count <> 0``) as a semi-join."""
    return obs.join(reading.select("obs_id"), "obs_id", "left_semi")


def strong_signals(reading: DataFrame, threshold: int = STRONG_DBM) -> DataFrame:
    return reading.filter(F.col("rssi") > threshold)


def scans_with_outlier(obs: DataFrame, reading: DataFrame, threshold: int = OUTLIER_DBM) -> DataFrame:
    """Scans with any signal above ``threshold`` (row-wise ``any``)."""
    return obs.join(reading.filter(F.col("rssi") > threshold).select("obs_id"), "obs_id", "left_semi")


def dataset_sizes(obs: DataFrame) -> DataFrame:
    """Scans per dataset tag; one row per tag, which the planner broadcasts by its measured size."""
    return obs.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_scans"))


def _grid(ap: DataFrame, datasets) -> DataFrame:
    """Every (dataset, AP) pair: the catalogue repeated once per fixed tag."""
    return ap.select("ap_id", F.explode(F.array(*[F.lit(d) for d in datasets])).alias("dataset"))


def heard_pairs(obs: DataFrame, reading: DataFrame) -> DataFrame:
    """(dataset, ap_id, n_heard): readings per AP within each dataset."""
    return (with_dataset(reading, obs).groupBy("dataset", "ap_id")
            .agg(F.count(F.lit(1)).alias("n_heard")))


def unheard_aps(obs: DataFrame, reading: DataFrame, ap: DataFrame, datasets=DATASETS) -> DataFrame:
    """(dataset, ap_id) for catalogue APs no scan of that dataset heard."""
    heard = heard_pairs(obs, reading)
    return _grid(ap, datasets).join(heard, ["dataset", "ap_id"], "left_anti").select("dataset", "ap_id")


def ap_null_counts(obs: DataFrame, reading: DataFrame, ap: DataFrame, datasets=DATASETS) -> DataFrame:
    """(dataset, ap_id, n_null): scans of the dataset that did not hear the AP."""
    sizes = dataset_sizes(obs)
    return (_grid(ap, datasets)
            .join(heard_pairs(obs, reading), ["dataset", "ap_id"], "left")
            .join(sizes, "dataset", "left")
            .select("dataset", "ap_id",
                    (F.coalesce("n_scans", F.lit(0)) - F.coalesce("n_heard", F.lit(0)))
                    .cast("bigint").alias("n_null")))


def varying_aps(obs: DataFrame, reading: DataFrame, fill: int = FILL_DBM) -> DataFrame:
    """APs whose filled value is not constant within a dataset (``nunique != 1``).

    The wide column holds each heard rssi plus ``fill`` for every scan that did
    not hear the AP, so its distinct count is the distinct heard values plus
    one when some scan missed the AP and no heard value equals ``fill``. APs
    heard by nobody are constant and never appear.
    """
    sizes = dataset_sizes(obs)
    per_ap = (with_dataset(reading, obs).groupBy("dataset", "ap_id")
              .agg(F.count(F.lit(1)).alias("n_heard"),
                   F.count_distinct("rssi").alias("n_values"),
                   F.max((F.col("rssi") == fill).cast("int")).alias("has_fill")))
    n_distinct = F.col("n_values") + F.when(
        (F.col("n_heard") < F.col("n_scans")) & (F.col("has_fill") == 0), 1).otherwise(0)
    return (per_ap.join(sizes, "dataset")
            .select("dataset", "ap_id", n_distinct.cast("bigint").alias("n_distinct"))
            .filter(F.col("n_distinct") > 1))


def restrict_to_known_aps(reading: DataFrame, known_aps: DataFrame) -> DataFrame:
    """Keep readings of APs in a catalogue (e.g. the APs a model was fit on)."""
    return reading.join(known_aps.select("ap_id").distinct(), "ap_id", "left_semi")


def prepare_survey(obs: DataFrame, reading: DataFrame, ap: DataFrame, drop_unheard_in: str | None = "test",
                   drop_empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """The preparation flow: drop APs never heard in ``drop_unheard_in``, then
    drop scans left with no signal. Returns (obs, reading)."""
    if drop_unheard_in:
        kept = (with_dataset(reading, obs).filter(F.col("dataset") == drop_unheard_in)
                .select("ap_id").distinct())
        reading = restrict_to_known_aps(reading, kept)
    if drop_empty:
        obs = drop_empty_scans(obs, reading)
    return obs, reading
