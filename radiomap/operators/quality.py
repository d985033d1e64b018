"""AP quality and description: extents, profiles, frequencies, histograms.

Every aggregate here groups by a small key (AP, dataset, phone, user), so
Spark's partial (map-side) aggregation shrinks the data before the shuffle; a
hot AP holding a third of all readings costs one extra row per map task, not a
third of the data in one reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiomap.functions.signal import OUTLIER_DBM, STRONG_DBM
from radiomap.operators.clean import DATASETS, heard_pairs, with_dataset

# Fixed value: an AP heard over more than this many metres is "noisy".
NOISY_EXTENT_M = 190.0


def ap_extent(obs: DataFrame, reading: DataFrame) -> DataFrame:
    """Per AP: min/max latitude and longitude of the scans that heard it."""
    r = with_dataset(reading, obs, "latitude", "longitude")
    return (r.groupBy("ap_id")
            .agg(F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
                 F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"))
            .withColumn("lat_diff", F.col("max_lat") - F.col("min_lat"))
            .withColumn("long_diff", F.col("max_lon") - F.col("min_lon"))
            .withColumn("max_diff", F.greatest("lat_diff", "long_diff")))


def noisy_aps(extent: DataFrame, threshold: float = NOISY_EXTENT_M) -> DataFrame:
    return extent.filter(F.col("max_diff") > threshold)


def ap_profile(obs: DataFrame, reading: DataFrame, ap: DataFrame, strong: int = STRONG_DBM,
               stats_dataset: str = "train", strong_datasets=("train", "val")) -> DataFrame:
    """Per catalogue AP: mean rssi and heard count in ``stats_dataset``, count of
    signals above ``strong`` in ``strong_datasets``, their rate and ln(count).

    One conditional aggregate over the readings, then a join to the catalogue
    so never-heard APs appear with count 0.
    """
    r = with_dataset(reading, obs)
    in_stats = F.col("dataset") == stats_dataset
    stats = (r.filter(F.col("dataset").isin(stats_dataset, *strong_datasets))
             .groupBy("ap_id")
             .agg(F.avg(F.when(in_stats, F.col("rssi"))).alias("avg_rssi"),
                  F.count(F.when(in_stats, F.lit(1))).alias("obs"),
                  F.count(F.when(F.col("dataset").isin(*strong_datasets) & (F.col("rssi") > strong),
                                 F.lit(1))).alias("above30")))
    n = F.coalesce("obs", F.lit(0)).cast("bigint")
    above = F.when(F.col("above30") > 0, F.col("above30").cast("bigint"))
    return (ap.select("ap_id").join(stats, "ap_id", "left")
            .select("ap_id", F.round("avg_rssi", 6).alias("avg_rssi"), n.alias("obs"),
                    above.alias("above30"),
                    F.round(F.try_divide(above.cast("double"), n.cast("double")), 6).alias("above30_rate"),
                    F.round(F.when(n > 0, F.ln(n.cast("double"))), 6).alias("ln_obs")))


def ap_label(profile: DataFrame) -> DataFrame:
    """Hover text for an AP: ``'WAP0007, 12 observations'`` and a short code."""
    return profile.select(
        "ap_id",
        F.concat_ws("", F.col("ap_id"), F.lit(", "), F.col("obs").cast("string"),
                    F.lit(" observations")).alias("label"),
        F.lower(F.substring("ap_id", 1, 3)).alias("prefix"))


def ap_dataset_coverage(obs: DataFrame, reading: DataFrame, left: str = "train",
                        right: str = "val") -> DataFrame:
    """Full outer join of per-AP heard counts in two datasets."""
    pairs = heard_pairs(obs, reading)
    a = pairs.filter(F.col("dataset") == left).select("ap_id", F.col("n_heard").alias("n_left"))
    b = pairs.filter(F.col("dataset") == right).select("ap_id", F.col("n_heard").alias("n_right"))
    return (a.join(b, "ap_id", "full_outer")
            .select("ap_id", F.coalesce("n_left", F.lit(0)).cast("bigint").alias(f"n_{left}"),
                    F.coalesce("n_right", F.lit(0)).cast("bigint").alias(f"n_{right}")))


def ap_frequency(reading: DataFrame) -> DataFrame:
    """``value_counts`` of APs: readings per AP, most frequent first."""
    return reading.groupBy("ap_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ap_id")


def outlier_phones(obs: DataFrame, reading: DataFrame, threshold: int = OUTLIER_DBM,
                   dataset: str = "train") -> DataFrame:
    """Scans with any signal above ``threshold``, counted per phone."""
    hot = reading.filter(F.col("rssi") > threshold).select("obs_id").distinct()
    return (obs.filter(F.col("dataset") == dataset).join(hot, "obs_id", "left_semi")
            .groupBy("phone_id").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "phone_id"))


def distinct_aps_by_building(obs: DataFrame, reading: DataFrame) -> DataFrame:
    return (with_dataset(reading, obs, "building_id").filter(F.col("building_id").isNotNull())
            .select("building_id", "ap_id").distinct())


def missing_ap_summary(obs: DataFrame, reading: DataFrame, ap: DataFrame, datasets=DATASETS) -> DataFrame:
    """Per dataset: APs heard, APs never heard, and the catalogue size.

    Readings only name catalogue APs, so heard + unheard is the catalogue.
    """
    pairs = heard_pairs(obs, reading).filter(F.col("dataset").isin(*datasets))
    grid = ap.select("ap_id", F.explode(F.array(*[F.lit(d) for d in datasets])).alias("dataset"))
    heard = F.count("n_heard")
    return (grid.join(pairs, ["dataset", "ap_id"], "left").groupBy("dataset")
            .agg(heard.alias("n_heard"), (F.count(F.lit(1)) - heard).alias("n_unheard"),
                 F.count(F.lit(1)).alias("n_catalogue")))


def rssi_histogram(obs: DataFrame, reading: DataFrame, width: int = 5) -> DataFrame:
    """Counts of dBm values per dataset in bins ``[lo, lo + width)``."""
    lo = (F.floor(F.col("rssi") / F.lit(width)) * width).cast("int")
    return (with_dataset(reading, obs).groupBy("dataset", lo.alias("bin_lo"))
            .agg(F.count(F.lit(1)).alias("n")))


def value_histogram(df: DataFrame, column: str, width: float = 1.0, by=()) -> DataFrame:
    """Generic fixed-width histogram of a numeric column."""
    lo = (F.floor(F.col(column) / F.lit(width)) * F.lit(width)).cast("double")
    return df.groupBy(*by, lo.alias("bin_lo")).agg(F.count(F.lit(1)).alias("n"))


def rssi_boxplot(obs: DataFrame, reading: DataFrame, by: str = "phone_id", dataset: str = "train",
                 whisker: float = 1.5) -> DataFrame:
    """Box-plot statistics of dBm per group: quartiles (linear interpolation),
    whiskers at the most extreme values inside 1.5 IQR, and outlier count.

    dBm is an integer with about a hundred values, so the readings are reduced
    once to a (group, rssi, count) histogram with partial aggregation; the
    quartiles (``percentile`` with a frequency column), fences and whiskers are
    then computed on that small table. No second pass over the readings."""
    r = with_dataset(reading, obs, by)
    if dataset:
        r = r.filter(F.col("dataset") == dataset)
    hist = r.groupBy(by, "rssi").agg(F.count(F.lit(1)).alias("_n"))
    q = hist.groupBy(by).agg(
        F.percentile("rssi", 0.25, F.col("_n")).alias("q1"), F.percentile("rssi", 0.5, F.col("_n")).alias("median"),
        F.percentile("rssi", 0.75, F.col("_n")).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    fences = q.select(by, "q1", "median", "q3",
                      (F.col("q1") - whisker * iqr).alias("lo_fence"),
                      (F.col("q3") + whisker * iqr).alias("hi_fence"))
    inside = (F.col("rssi") >= F.col("lo_fence")) & (F.col("rssi") <= F.col("hi_fence"))
    tails = (hist.join(fences, by)
             .groupBy(by)
             .agg(F.min(F.when(inside, F.col("rssi"))).alias("lower_whisker"),
                  F.max(F.when(inside, F.col("rssi"))).alias("upper_whisker"),
                  F.sum(F.when(~inside, F.col("_n")).otherwise(0)).alias("n_outliers"),
                  F.sum("_n").alias("n")))
    return fences.join(tails, by).select(
        by, F.col("n").cast("bigint").alias("n"), F.round("q1", 6).alias("q1"),
        F.round("median", 6).alias("median"), F.round("q3", 6).alias("q3"), "lower_whisker", "upper_whisker",
        F.col("n_outliers").cast("bigint").alias("n_outliers"))


def ap_by_mean_signal(obs: DataFrame, reading: DataFrame, dataset: str = "train") -> DataFrame:
    """Mean rssi per AP in one dataset, strongest first."""
    return (with_dataset(reading, obs).filter(F.col("dataset") == dataset)
            .groupBy("ap_id").agg(F.round(F.avg("rssi"), 6).alias("avg_rssi"),
                                  F.count(F.lit(1)).alias("obs"))
            .orderBy(F.desc("avg_rssi"), "ap_id"))


def locations_by_user(obs: DataFrame, dataset: str = "train") -> DataFrame:
    """Per user: scans, distinct surveyed locations and the bounding box."""
    o = obs.filter(F.col("dataset") == dataset)
    return (o.groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("n_scans"),
                 F.count_distinct("latitude", "longitude").alias("n_locations"),
                 F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
                 F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon")))
