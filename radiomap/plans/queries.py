"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query derives the survey views from the driver's tables with Spark and
then applies one operator (or a composed flow). Oracle SQL with the same
column names lives in ``radiomap.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiomap.functions import signal as sig
from radiomap.operators import (bagging, clean, evaluate, features, indexing, knn, models, quality, quantiles, rank,
                                reshape, sampling, search, splits)
from radiomap.operators import boosted
from radiomap.operators.boosted import StagedBooster, boosted_classes
from radiomap.plans import flows
from radiomap.session import shared_dir
from radiomap.sources import fixtures as fx
from radiomap.sources import survey as survey_io

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


# --- minimum slice -----------------------------------------------------------

@register("signal_count")
def q_signal_count(spark, sf):
    return clean.signal_count(fx.obs(spark, sf), fx.reading(spark, sf))


@register("ap_extent")
def q_ap_extent(spark, sf):
    return quality.ap_extent(fx.obs(spark, sf), fx.reading(spark, sf))


@register("noisy_aps")
def q_noisy_aps(spark, sf):
    return quality.noisy_aps(quality.ap_extent(fx.obs(spark, sf), fx.reading(spark, sf)))


# --- cleaning ------------------------------------------------------------------

@register("drop_empty_scans")
def q_drop_empty(spark, sf):
    return clean.drop_empty_scans(fx.obs(spark, sf), fx.reading(spark, sf)).select(
        "obs_id", "dataset", "building_id", "floor")


@register("strong_signals")
def q_strong(spark, sf):
    return clean.strong_signals(fx.reading(spark, sf))


@register("scans_with_outlier")
def q_scans_outlier(spark, sf):
    return clean.scans_with_outlier(fx.obs(spark, sf), fx.reading(spark, sf)).select(
        "obs_id", "dataset", "user_id", "phone_id")


@register("unheard_aps")
def q_unheard(spark, sf):
    return clean.unheard_aps(fx.obs(spark, sf), fx.reading(spark, sf), fx.ap(spark, sf))


@register("ap_null_counts")
def q_ap_null_counts(spark, sf):
    return clean.ap_null_counts(fx.obs(spark, sf), fx.reading(spark, sf), fx.ap(spark, sf))


@register("varying_aps")
def q_varying(spark, sf):
    return clean.varying_aps(fx.obs(spark, sf), fx.reading(spark, sf))


@register("restrict_to_known_aps")
def q_restrict(spark, sf):
    """Readings of the unlabeled set limited to APs heard in training."""
    obs, r = fx.survey(spark, sf)
    rd = clean.with_dataset(r, obs)
    known = rd.filter(F.col("dataset") == "train").select("ap_id")
    return clean.restrict_to_known_aps(rd.filter(F.col("dataset") == "test"), known).select(
        "obs_id", "ap_id", "rssi")


@register("prepare_survey")
def q_prepare(spark, sf):
    obs, r = fx.survey(spark, sf)
    o2, r2 = clean.prepare_survey(obs, r, fx.ap(spark, sf))
    return clean.signal_count(o2, r2)


# --- AP quality ------------------------------------------------------------------

@register("ap_profile")
def q_ap_profile(spark, sf):
    return quality.ap_profile(fx.obs(spark, sf), fx.reading(spark, sf), fx.ap(spark, sf))


@register("ap_label")
def q_ap_label(spark, sf):
    return quality.ap_label(quality.ap_profile(fx.obs(spark, sf), fx.reading(spark, sf), fx.ap(spark, sf)))


@register("ap_dataset_coverage")
def q_ap_cov(spark, sf):
    return quality.ap_dataset_coverage(fx.obs(spark, sf), fx.reading(spark, sf))


@register("ap_frequency")
def q_ap_freq(spark, sf):
    return quality.ap_frequency(fx.reading(spark, sf))


@register("outlier_phones")
def q_outlier_phones(spark, sf):
    return quality.outlier_phones(fx.obs(spark, sf), fx.reading(spark, sf))


@register("distinct_aps_by_building")
def q_aps_by_building(spark, sf):
    return quality.distinct_aps_by_building(fx.obs(spark, sf), fx.reading(spark, sf))


@register("missing_ap_summary")
def q_missing_summary(spark, sf):
    return quality.missing_ap_summary(fx.obs(spark, sf), fx.reading(spark, sf), fx.ap(spark, sf))


@register("rssi_histogram")
def q_rssi_hist(spark, sf):
    return quality.rssi_histogram(fx.obs(spark, sf), fx.reading(spark, sf))


@register("signal_count_histogram")
def q_sigcount_hist(spark, sf):
    sc = clean.signal_count(fx.obs(spark, sf), fx.reading(spark, sf))
    return sc.groupBy("sig_count").agg(F.count(F.lit(1)).alias("n"))


@register("rssi_boxplot")
def q_boxplot(spark, sf):
    return quality.rssi_boxplot(fx.obs(spark, sf), fx.reading(spark, sf))


@register("ap_by_mean_signal")
def q_ap_by_mean(spark, sf):
    return quality.ap_by_mean_signal(fx.obs(spark, sf), fx.reading(spark, sf))


@register("locations_by_user")
def q_loc_by_user(spark, sf):
    return quality.locations_by_user(fx.obs(spark, sf))


# --- sources, projections, filters, row-wise expressions ---------------------------



@register("load_survey")
def q_load_survey(spark, sf):
    return fx.obs(spark, sf)


@register("tag_dataset")
def q_tag_dataset(spark, sf):
    """Three surveys read separately, each tagged with its source, then unioned."""
    o = fx.obs(spark, sf).select("obs_id", "dataset")
    parts = [clean.tag_dataset(o.filter(F.col("dataset") == d).drop("dataset"), d) for d in clean.DATASETS]
    return reshape.union_surveys(*parts)


@register("select_ap_columns")
def q_select_ap(spark, sf):
    return clean.select_by_prefix(fx.scan_wide(spark, sf), "AP_", keep=("obs_id", "panel"))


@register("select_first_columns")
def q_select_position(spark, sf):
    """The id columns and the signals by position, as the wide file is cut up."""
    w = fx.scan_wide(spark, sf)
    first = w.columns.index(fx.WIDE_APS[0])
    return clean.select_by_position(w, first, first + 8, keep=("obs_id", "panel"))


@register("reorder_labels")
def q_reorder(spark, sf):
    return reshape.reorder_labels(fx.obs(spark, sf))


@register("filter_by_dataset")
def q_filter_dataset(spark, sf):
    o = fx.obs(spark, sf)
    return o.filter((F.col("dataset") == "train") & ((F.col("building_id") == 1) | (F.col("floor") == 2))) \
        .select("obs_id", "dataset", "building_id", "floor")


@register("filter_location")
def q_filter_location(spark, sf):
    o = fx.obs(spark, sf)
    return o.filter((F.col("building_id") == 1) & (F.col("floor") == 2) & (F.col("space_id") == 100)) \
        .select("obs_id", "longitude", "latitude", "space_id")


@register("sentinel_to_null")
def q_sentinel(spark, sf):
    w = fx.scan_wide(spark, sf)
    return sig.sentinel_to_null(w, sig.ap_columns(w, "AP_"))


@register("fill_missing_signal")
def q_fill(spark, sf):
    w = fx.scan_wide(spark, sf)
    aps = sig.ap_columns(w, "AP_")
    return sig.fill_missing(sig.sentinel_to_null(w, aps), aps)


@register("sentinel_to_fill")
def q_sentinel_to_fill(spark, sf):
    w = fx.scan_wide(spark, sf)
    return sig.sentinel_to_fill(w, sig.ap_columns(w, "AP_"))


@register("dbm_to_mw")
def q_dbm_to_mw(spark, sf):
    r = fx.reading(spark, sf)
    return r.select("obs_id", "ap_id", "rssi", F.round(sig.dbm_to_mw(F.col("rssi")), 15).alias("mw"))


@register("row_index")
def q_row_index(spark, sf):
    o = fx.obs(spark, sf).select("obs_id", "dataset")
    return indexing.row_index(o, ["obs_id"], group_cols=["dataset"], name="row_idx")


# --- reshape, rank, encode ----------------------------------------------------------

@register("wide_to_long")
def q_wide_to_long(spark, sf):
    """Every reading back from the wide panels."""
    w = fx.scan_wide(spark, sf)
    long = reshape.wide_to_long(w, ["obs_id", "panel"], sig.ap_columns(w, "AP_"))
    number = F.col("panel").cast("bigint") * fx.PANEL + F.substring("ap_id", 4, 2).cast("bigint")
    return long.select("obs_id", fx.ap_name(number).alias("ap_id"), "rssi")


@register("long_to_wide")
def q_long_to_wide(spark, sf):
    """Readings pivoted over the whole catalogue, in panels of AP columns."""
    return fx.panels(fx.panel_readings(spark, sf))


@register("rank_signals")
def q_rank(spark, sf):
    return rank.rank_signals(fx.reading(spark, sf))


@register("rank_weakest")
def q_rank_weak(spark, sf):
    return rank.rank_signals(fx.reading(spark, sf), ascending=True, k=1)


@register("topk_signals")
def q_topk(spark, sf):
    return rank.topk_signals(fx.reading(spark, sf), k=10)


@register("pivot_ranks")
def q_pivot_ranks(spark, sf):
    return reshape.pivot_ranks(rank.topk_signals(fx.reading(spark, sf), k=10), k=10)


@register("scan_with_ranks")
def q_scan_with_ranks(spark, sf):
    o = fx.obs(spark, sf).select("obs_id", "dataset", "building_id", "floor")
    return o.join(reshape.pivot_ranks(rank.topk_signals(fx.reading(spark, sf), k=10), k=10), "obs_id", "left")


@register("one_hot_ranks")
def q_one_hot(spark, sf):
    return reshape.one_hot_ranks(rank.topk_signals(fx.reading(spark, sf), k=10), k=10)


@register("factorize_floor")
def q_factorize(spark, sf):
    o = fx.obs(spark, sf).filter(F.col("dataset") == "train")
    return reshape.factorize(o, "floor")


@register("encode_floor")
def q_encode(spark, sf):
    """Validation floors in the codes of the training survey (one code table)."""
    o = fx.obs(spark, sf)
    codes = reshape.factorize(o.filter(F.col("dataset") == "train"), "floor")
    return reshape.apply_codes(o.filter(F.col("dataset") == "val").select("obs_id", "floor"), codes, "floor").select(
        "obs_id", "floor", "code")


@register("floor_histogram")
def q_floor_histogram(spark, sf):
    """Generic fixed-width histogram, of coordinates by dataset."""
    o = fx.obs(spark, sf).filter(F.col("dataset") != "test")
    return quality.value_histogram(o, "longitude", 20.0, by=("dataset",))


@register("union_surveys")
def q_union(spark, sf):
    o = fx.obs(spark, sf)
    labeled = o.filter(F.col("dataset") != "test").select(
        "obs_id", "dataset", "building_id", "floor", "longitude", "latitude")
    unlabeled = o.filter(F.col("dataset") == "test").select("obs_id", "dataset", "space_id")
    return reshape.union_surveys(labeled, unlabeled)


@register("distinct_locations")
def q_distinct_loc(spark, sf):
    return reshape.distinct_locations(fx.obs(spark, sf).filter(F.col("dataset") == "train"))


@register("all_locations")
def q_all_loc(spark, sf):
    return reshape.all_locations(fx.obs(spark, sf))


@register("common_aps")
def q_common_aps(spark, sf):
    return reshape.common_aps(fx.obs(spark, sf), fx.reading(spark, sf))


@register("ap_overlap_buildings")
def q_overlap(spark, sf):
    return reshape.ap_overlap_buildings(fx.obs(spark, sf), fx.reading(spark, sf))


@register("duplicate_scans")
def q_dups(spark, sf):
    """Copies by every column but the id."""
    return reshape.duplicate_scans(fx.obs(spark, sf), fx.reading(spark, sf))


@register("duplicate_places")
def q_dup_places(spark, sf):
    """Scans that hear the same at the same place, whoever took them and when."""
    return reshape.duplicate_scans(fx.obs(spark, sf), fx.reading(spark, sf), reshape.PLACE_COLS)


@register("survey_csv")
def q_survey_csv(spark, sf):
    """The wide survey written as CSV and read with its declared schema."""
    w = fx.scan_wide(spark, sf)
    path = survey_io.write_table(w, shared_dir(spark, "survey_csv"), fmt="csv")
    return survey_io.read_survey_csv(spark, path, w.schema).select("obs_id", "dataset", "panel", *fx.WIDE_APS)


# Lines that the dirty survey spoils, by obs_id modulo 50.
DIRTY_VALUE, DIRTY_SHORT, DIRTY_LONG = 7, 11, 13
DIRTY_SCHEMA = "obs_id long, dataset string, floor int, longitude double, user_id int"


def _dirty_csv(spark, sf):
    """The scans as CSV files, one folder a dataset, of which some lines are spoilt: a
    floor that is no number, a field too few, a field too many."""
    o = fx.obs(spark, sf)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rule = F.pmod("obs_id", F.lit(50))
    floor = F.when(rule == DIRTY_VALUE, F.lit("ground")).otherwise(text("floor"))
    line = F.concat_ws(",", text("obs_id"), text("dataset"), floor, text("longitude"))
    line = F.when(rule == DIRTY_SHORT, line).when(rule == DIRTY_LONG, F.concat_ws(",", line, text("user_id"), F.lit("9"))).otherwise(
        F.concat_ws(",", line, text("user_id")))
    header = "obs_id,dataset,floor,longitude,user_id"  # one column, written under the names of five
    path = shared_dir(spark, "dirty_csv")
    (o.select(line.alias(header), F.col("dataset").alias("part")).write.partitionBy("part")
     .option("header", True).option("sep", "\u0001").option("escapeQuotes", False).csv(path))
    return survey_io.read_checked_csv(spark, f"{path}/*", spark.createDataFrame([], DIRTY_SCHEMA).schema)


@register("dirty_csv_rows")
def q_dirty_csv_rows(spark, sf):
    """The rows of the good lines."""
    return _dirty_csv(spark, sf)[0]


@register("dirty_csv_faults")
def q_dirty_csv_faults(spark, sf):
    """Faulty lines by folder and fault."""
    folder = F.regexp_extract("file", "part=([^/]*)/", 1)
    return survey_io.fault_counts(_dirty_csv(spark, sf)[1].withColumn("file", folder)).withColumnRenamed("file", "dataset")


@register("longitude_boxplot")
def q_longitude_boxplot(spark, sf):
    """Box plot of the training scans' longitude by phone."""
    return quantiles.boxplot(fx.obs(spark, sf).filter("dataset = 'train'"), "phone_id", "longitude")


@register("price_quantiles")
def q_price_quantiles(spark, sf):
    """Percentiles 1, 10, 50, 90 and 99 of all line prices by flag: groups far larger
    than the sketch, so the ranges decide."""
    li = fx.table(spark, sf, "lineitem", "l_returnflag", "l_extendedprice")
    q = quantiles.exact_quantiles(li, ["l_returnflag"], "l_extendedprice", (0.01, 0.1, 0.5, 0.9, 0.99), accuracy=1_000)
    return q.select("l_returnflag", "n", *[F.round(F.get("quantiles", F.lit(k)), 6).alias(c) for k, c in enumerate(("p01", "p10", "p50", "p90", "p99"))])


OOB_TREES = 20


@register("oob_bags")
def q_oob_bags(spark, sf):
    """By tree: training scans in its bag, their copies, and those that it has not seen."""
    bags = bagging.bag_table(flows.ml_data(spark, sf).train, OOB_TREES)
    inside = F.col("copies") > 0
    return bags.groupBy("tree").agg(F.count(F.when(inside, 1)).alias("n_in_bag"), F.sum("copies").alias("n_copies"),
                                    F.count(F.when(~inside, 1)).alias("n_oob"))


@register("oob_score")
def q_oob_score(spark, sf):
    """Out-of-bag score of a building forest: scans and votes that count, and whether
    more are right than the most frequent building would give."""
    models_, data = bagging.fit_bagged(flows.ml_data(spark, sf).train, "building_id", OOB_TREES)
    score = bagging.out_of_bag_score(bagging.out_of_bag_votes(models_, data), data, "building_id")
    most = data.groupBy("building_id").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("base"))
    return score.join(most).select("n_scored", "n_votes", (F.col("score") > F.col("base")).alias("beats_majority"))


@register("head_rows")
def q_head(spark, sf):
    return fx.obs(spark, sf).select("obs_id", "dataset").orderBy("obs_id").limit(10)


# --- sampling and splits --------------------------------------------------------------

def _labeled(spark, sf, dataset):
    return fx.obs(spark, sf).filter(F.col("dataset") == dataset).select("obs_id", "building_id", "floor")


@register("stratified_sample")
def q_strat(spark, sf):
    return sampling.stratified_sample(_labeled(spark, sf, "train"), ["building_id", "floor"], 400,
                                      salt="tr_samp")


@register("sample_n")
def q_sample_n(spark, sf):
    return sampling.sample_n(_labeled(spark, sf, "val"), 250, salt="test_val").select("obs_id")


@register("bootstrap_sample")
def q_bootstrap(spark, sf):
    return sampling.bootstrap(_labeled(spark, sf, "val"), 0.5, seed=32, salt="val_half").select(
        "obs_id", F.col("copy_no").cast("int").alias("copy_no"))


@register("bootstrap_exact")
def q_bootstrap_exact(spark, sf):
    """Half as many draws with replacement as there are validation scans."""
    return sampling.bootstrap_exact(_labeled(spark, sf, "val").select("obs_id"), 0.5, seed=32, salt="val_exact")


@register("random_split")
def q_random_split(spark, sf):
    o = fx.obs(spark, sf).filter(F.col("dataset") != "test").select("obs_id")
    return sampling.random_split(o, 0.75)


@register("split_5_1")
def q_split_5_1(spark, sf):
    return splits.split_5_1(fx.obs(spark, sf))


@register("split_all_train")
def q_split_all(spark, sf):
    return splits.split_all_train(fx.obs(spark, sf))


@register("split_half_val")
def q_split_half(spark, sf):
    return splits.split_half_val(fx.obs(spark, sf))


@register("split_sample2")
def q_split2(spark, sf):
    return splits.split_sample2(fx.obs(spark, sf))


@register("holdout_complement")
def q_complement(spark, sf):
    tr = _labeled(spark, sf, "train")
    held = sampling.stratified_sample(tr, ["building_id", "floor"], 400, salt="tr_samp")
    return splits.holdout_complement(tr, held).select("obs_id")


@register("ap_group_table")
def q_ap_groups(spark, sf):
    obs, r = fx.survey(spark, sf)
    groups = survey_io.ap_groups(obs, r, fx.ap(spark, sf))
    return survey_io.roundtrip_parquet(spark, groups, "ap_groups")


# --- kNN prediction and evaluation ------------------------------------------------------



@register("knn_neighbors")
def q_knn_neighbors(spark, sf):
    return flows.knn_run(spark, sf).neighbors


@register("knn_building")
def q_knn_building(spark, sf):
    return flows.knn_run(spark, sf).predictions["building_id"]


@register("knn_floor")
def q_knn_floor(spark, sf):
    return flows.knn_run(spark, sf).predictions["floor"]


@register("knn_longitude")
def q_knn_longitude(spark, sf):
    p = flows.knn_run(spark, sf).predictions["longitude"]
    return p.select("obs_id", F.round("prediction", 6).alias("prediction"))


@register("knn_latitude")
def q_knn_latitude(spark, sf):
    p = flows.knn_run(spark, sf).predictions["latitude"]
    return p.select("obs_id", F.round("prediction", 6).alias("prediction"))


@register("combine_predictions")
def q_combine(spark, sf):
    """Predictions of all targets side by side for each scan (by id, not by position)."""
    return flows.knn_run(spark, sf).wide.select("obs_id", *[
        (F.round(t, 6) if t in flows.REG_TARGETS else F.col(t)).alias(f"{t}_pred")
        for t in (*flows.CLASS_TARGETS, *flows.REG_TARGETS)])


@register("prediction_counts")
def q_pred_counts(spark, sf):
    p = flows.knn_run(spark, sf).predictions["building_id"]
    return p.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@register("confusion_matrix")
def q_confusion(spark, sf):
    """Building and floor, on the test set and on its hard part."""
    s = flows.knn_run(spark, sf).scored.filter(F.col("target").isin(*flows.CLASS_TARGETS))
    return evaluate.confusion_matrix(s)


@register("confusion_wide")
def q_confusion_wide(spark, sf):
    """The floor matrix with a column for each predicted floor."""
    s = flows.knn_run(spark, sf).scored.filter(F.col("target") == "floor")
    w = evaluate.confusion_wide(s, range(5), by=("split",))
    return w.select("split", "actual", *[F.col(f"`{float(c)}`").alias(f"floor_{c}") for c in range(5)])


@register("accuracy")
def q_accuracy(spark, sf):
    s = flows.knn_run(spark, sf).scored.filter(F.col("target").isin(*flows.CLASS_TARGETS))
    return evaluate.accuracy(s)


@register("cohen_kappa")
def q_kappa(spark, sf):
    s = flows.knn_run(spark, sf).scored.filter(F.col("target").isin(*flows.CLASS_TARGETS))
    return evaluate.cohen_kappa(s)


@register("mae")
def q_mae(spark, sf):
    s = flows.knn_run(spark, sf).scored.filter(F.col("target").isin(*flows.REG_TARGETS))
    return evaluate.mae(s)


@register("residuals")
def q_residuals(spark, sf):
    s = flows.knn_run(spark, sf).scored.filter(F.col("target").isin(*flows.REG_TARGETS))
    return evaluate.residuals(s)


@register("zero_position")
def q_zero_pos(spark, sf):
    s = flows.knn_run(spark, sf).scored.filter(F.col("target").isin(*flows.REG_TARGETS))
    return evaluate.zero_position(evaluate.residuals(s), "error", by=("target", "split"))


@register("evaluation_report")
def q_eval_report(spark, sf):
    return evaluate.evaluation_report(flows.knn_run(spark, sf).scored, flows.CLASS_TARGETS, flows.REG_TARGETS)


@register("residual_surface")
def q_residual_surface(spark, sf):
    run = flows.knn_run(spark, sf)
    return evaluate.residual_surface(run.scored, run.obs, flows.REG_TARGETS)


# --- Spark ML: features, models, search, cascades --------------------------------------



@register("feature_vectors")
def q_feature_vectors(spark, sf):
    """The entries of every scan's sparse vector."""
    obs, r = fx.survey(spark, sf)
    index = features.ap_index(fx.ap(spark, sf))
    return features.vector_entries(features.feature_vectors(obs, r, index, index.count()))


@register("standardize")
def q_standardize(spark, sf):
    return features.scaler_stats(fx.obs(spark, sf), fx.reading(spark, sf))


# Trees, rounds, draws, folds and patience are the surveyed models' (models.py,
# boosted.py and the grids below). Boosted models fit on all training rows.

# The surveyed search grids.
FOREST_GRID = {"numTrees": [80, 100, 120], "featureSubsetStrategy": ["auto", "sqrt"], "maxDepth": [10, 50, 100, 30],
               "minInstancesPerNode": [1, 2, 4], "bootstrap": [True, False]}
FOREST_DRAWS, BOOSTED_DRAWS, FOLDS = 9, 8, 5
EXHAUSTIVE_GRID = {"numTrees": [100, 250], "featureSubsetStrategy": ["auto", "sqrt", "log2"]}
BOOSTED_GRID = {"max_depth": [3, 7, 13, 16], "learning_rate": [0.05, 0.1, 0.15, 0.2]}
#: Labelled rows on which the draws of ``random_search`` and ``grid_search`` are compared (documented bound of the sample);
#: ``boosted_search`` and the tuned flow compare theirs on all.
SEARCH_ROWS = 1_000


def _fit_score(spark, sf, estimator, label):
    d = flows.ml_data(spark, sf)
    model = models.fit(estimator, d.train, label)
    return models.score(model, d.test)


def _watch(d):
    """The part of the test set from the validation survey; it stops boosting."""
    hard = d.split.filter(F.col("split") == "hard_test").select("obs_id")
    return d.test.join(hard, "obs_id", "left_semi")


def _boost_score(spark, sf, label, classify=False):
    d = flows.ml_data(spark, sf)
    model = boosted_classes(d.train, _watch(d), label) if classify else StagedBooster(label, _watch(d)).fit(d.train)
    return models.score(model, d.test)


@register("rf_building")
def q_rf_building(spark, sf):
    return _fit_score(spark, sf, models.rf_classifier("building_id"), "building_id")


@register("rf_floor")
def q_rf_floor(spark, sf):
    return _fit_score(spark, sf, models.rf_classifier("floor"), "floor")


@register("rf_longitude")
def q_rf_longitude(spark, sf):
    return _fit_score(spark, sf, models.rf_regressor("longitude"), "longitude")


@register("gbt_building")
def q_gbt_building(spark, sf):
    return _boost_score(spark, sf, "building_id", classify=True)


@register("gbt_floor")
def q_gbt_floor(spark, sf):
    return _boost_score(spark, sf, "floor", classify=True)


@register("gbt_latitude")
def q_gbt_latitude(spark, sf):
    return _boost_score(spark, sf, "latitude")


@register("gbt_longitude")
def q_gbt_longitude(spark, sf):
    return _boost_score(spark, sf, "longitude")


@register("svm_building")
def q_svm_building(spark, sf):
    return _fit_score(spark, sf, models.svm_classifier("building_id"), "building_id")


@register("random_search")
def q_random_search(spark, sf):
    """Floor forest: nine draws from the grid, five folds each."""
    d = flows.ml_data(spark, sf)
    return search.tune(models.rf_classifier("floor"), FOREST_GRID, d.train, "floor", FOREST_DRAWS, FOLDS,
                       rows=SEARCH_ROWS).table


@register("grid_search")
def q_grid_search(spark, sf):
    """Building forest: the whole grid, five folds each."""
    d = flows.ml_data(spark, sf)
    return search.tune(models.rf_classifier("building_id"), EXHAUSTIVE_GRID, d.train, "building_id", None, FOLDS,
                       rows=SEARCH_ROWS).table


@register("boosted_search")
def q_boosted_search(spark, sf):
    """Latitude and longitude: eight draws from the grid, five folds each, on all
    training rows, up to 500 rounds with early stopping."""
    d = flows.ml_data(spark, sf)
    out = None
    for t in flows.REG_TARGETS:
        found = search.tune_boosted(BOOSTED_GRID, d.train, _watch(d), t, BOOSTED_DRAWS, FOLDS)
        rows = found.table.withColumn("target", F.lit(t))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("early_stopping_curve")
def q_early_stopping(spark, sf):
    """Boosted longitude: the watched error of every round, the round that is
    kept and the one at which ten without a gain stopped the fit."""
    d = flows.ml_data(spark, sf)
    model = StagedBooster("longitude", _watch(d)).fit(d.train)
    return search.curve_table(spark, model.curve)


@register("early_stopping_rule")
def q_early_stopping_rule(spark, sf):
    """A fit against the rule and against its own predictions, one row: the watched scans
    and the error there of always answering the training mean, both of which SQL
    states; whether the kept model's error, taken anew from its predictions, is the
    curve's least, its trees are the kept rounds, and it is below the mean's."""
    d = flows.ml_data(spark, sf)
    watch = _watch(d)
    model = StagedBooster("longitude", watch).fit(d.train)
    kept, stopped = boosted.patience_stop(model.curve)
    y = F.col("longitude")
    mean = d.train.agg(F.avg(y)).first()[0]
    again = model.transform(watch).agg(
        F.count(F.lit(1)).alias("n_watched"), F.round(F.avg(F.abs(y - F.lit(mean))), 6).alias("mean_error"), F.avg(F.abs(y - F.col("prediction"))).alias("error"))
    error = F.col("error")
    return again.select("n_watched", "mean_error", (F.abs(error - F.lit(min(model.curve))) < 1e-6).alias("same_error"),
                        F.lit(kept == model.best == model.trees and stopped == len(model.curve)).alias("kept_best"),
                        (error < F.col("mean_error")).alias("beats"))


def _rf_stage(target, feats):
    if target in flows.CLASS_TARGETS:
        return models.rf_classifier(target, features=feats)
    return models.rf_regressor(target, features=feats)


@register("cascade_location")
def q_cascade(spark, sf):
    """building -> (APs + building) -> longitude -> (APs + building + longitude) -> latitude."""
    d = flows.ml_data(spark, sf)
    stages = [("building_id", _rf_stage), ("longitude", _rf_stage), ("latitude", _rf_stage)]
    return models.cascade(d.train, d.test, stages)


@register("scenario_predictions")
def q_scenarios(spark, sf):
    """Five scenarios for the unlabeled scans: nearest fingerprints for the
    building, forest or boosted floor, boosted or forest coordinates, with the
    building (and longitude) predicted before as further inputs; two training
    samples."""
    return flows.scenarios(spark, sf)


@register("scenario_counts")
def q_scenario_counts(spark, sf):
    """Rows, scans and gaps of every scenario's predictions."""
    s = flows.scenarios(spark, sf)
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in ("building_id", "floor", "longitude", "latitude")])
    return s.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("obs_id").alias("n_scans"),
                                     F.sum(missing).alias("n_missing"))


@register("prediction_table")
def q_prediction_table(spark, sf):
    """The tuned flow's predictions for the unlabeled scans (``flows.tuned``);
    column names carry the model."""
    return flows.tuned(spark, sf).predictions


@register("feature_importance")
def q_feature_importance(spark, sf):
    d = flows.ml_data(spark, sf)
    model = models.fit(models.rf_classifier("floor"), d.train, "floor")
    return models.feature_importance(model, d.index)


@register("model_description")
def q_model_description(spark, sf):
    """What the floor forest is made of: trees, classes, inputs."""
    d = flows.ml_data(spark, sf)
    about = models.describe(models.fit(models.rf_classifier("floor"), d.train, "floor"))
    return spark.createDataFrame([(about["trees"], about["classes"], about["features"])],
                                 "n_trees int, n_classes int, n_features int")


@register("model_gates")
def q_model_gates(spark, sf):
    """Every kind of model against a baseline that SQL can state: (model, target,
    scans scored, gaps, the baseline's error, whether the model's is smaller)."""
    return flows.model_gates(spark, sf)


@register("rank_forest_crosstab")
def q_rank_forest(spark, sf):
    """Floor forest of five trees on the one-hot ranks of the ten strongest APs:
    actual against predicted codes of the validation scans, one code table."""
    return flows.rank_forest(spark, sf).groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


@register("rank_forest_rows")
def q_rank_forest_rows(spark, sf):
    """Scans of each actual code that the rank forest scored."""
    p = flows.rank_forest(spark, sf)
    return p.groupBy("actual").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("predicted").isNull().cast("int")).alias("n_missing"))


@register("pca_explained")
def q_pca(spark, sf):
    d = flows.ml_data(spark, sf)
    return features.pca_explained(d.train, k=3)


def _saved_forest(spark, sf):
    d = flows.ml_data(spark, sf)
    path, label = shared_dir(spark, "forest"), "longitude"
    model = models.fit(models.rf_regressor(label, num_trees=20, max_depth=8), d.train, label)
    models.save_model(model, path)
    return d, model, models.tree_table(spark, path, d.index)


@register("forest_trees")
def q_forest_trees(spark, sf):
    """The trees of a saved forest: by tree, leaves beyond the inner nodes (one, as in every
    binary tree), inner nodes without a known AP, and nodes that no other leads to."""
    _, _, t = _saved_forest(spark, sf)
    inner = F.col("left_node").isNotNull()
    reached = t.select("tree", F.explode(F.array("left_node", "right_node")).alias("node")).where("node is not null")
    return (t.join(reached.withColumn("has", F.lit(True)), ["tree", "node"], "left").groupBy("tree")
            .agg((F.count(F.when(~inner, 1)) - F.count(F.when(inner, 1))).alias("leaf_excess"),
                 F.count(F.when(inner & F.col("ap_id").isNull(), 1)).alias("unknown_aps"), F.count(F.when(F.col("has").isNull(), 1)).alias("roots")))


@register("forest_tree_scores")
def q_forest_tree_scores(spark, sf):
    """Test scans scored by joins with the saved forest's nodes, and those on which the
    model's own prediction differs."""
    d, model, t = _saved_forest(spark, sf)
    entries = features.vector_entries(d.test).join(d.index, "idx").select("obs_id", "ap_id", "x")
    joined = models.score_by_trees(t, d.test.select("obs_id"), entries, 8)
    both = joined.join(models.score(model, d.test, "own"), "obs_id", "full")
    same = F.coalesce(F.abs(F.col("prediction") - F.col("own")) < 1e-6, F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("n_scored"), F.count(F.when(~same, 1)).alias("n_differ"))


@register("model_cache_roundtrip")
def q_model_cache(spark, sf):
    """Fit-or-load twice against one path: the second call loads the saved
    model; its predictions are returned."""
    d = flows.ml_data(spark, sf)
    path = shared_dir(spark, "model_cache")
    est = models.rf_classifier("building_id", num_trees=20)
    models.load_or_fit(path, est, d.train, "building_id")
    loaded = models.load_or_fit(path, est, d.train, "building_id")
    return models.score(loaded, d.test)


@register("model_cache_same")
def q_model_cache_same(spark, sf):
    """Scans predicted, and those on which the fitted and the loaded model differ."""
    d = flows.ml_data(spark, sf)
    path = shared_dir(spark, "model_cache")
    est = models.rf_classifier("building_id", num_trees=20)
    a = models.score(models.load_or_fit(path, est, d.train, "building_id"), d.test, "a")
    b = models.score(models.load_or_fit(path, est, d.train, "building_id"), d.test, "b")
    return a.join(b, "obs_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("a") != F.col("b")).cast("int")).alias("n_differ"))


@register("roundtrip_predictions")
def q_roundtrip_predictions(spark, sf):
    """kNN building predictions written as CSV (obs_id as the index column) and read back."""
    p = flows.knn_run(spark, sf).predictions["building_id"]
    return survey_io.roundtrip_csv(spark, p, "predictions")


@register("model_report")
def q_model_report(spark, sf):
    """The tuned flow's two-level report: floor accuracy and kappa, coordinate
    errors, on the test set and on its validation-only part, before and after
    the refit on all labelled rows."""
    return flows.tuned(spark, sf).report
