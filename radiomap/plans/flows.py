"""Composed flows shared by several registered queries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiomap.functions.hashing import hash_uniform
from radiomap.operators import evaluate, features, knn, models, rank, reshape, search, splits
from radiomap.operators.boosted import StagedBooster, boosted_classes
from radiomap.operators.indexing import row_index
from radiomap.operators.sparse_trees import SparseForest
from radiomap.session import materialize
from radiomap.sources import fixtures as fx

CLASS_TARGETS = ("building_id", "floor")
REG_TARGETS = ("longitude", "latitude")
FLOOR_MODEL = "floor_forest_5_1_final"
WATCHED = 0.1  # share of a scenario's sample that stops its boosting


class KnnRun:
    """The 5:1 split, k nearest training fingerprints for every test scan, votes
    and means, and the scored table for ``test`` and ``hard_test``. Each part is
    made when it is first asked for, from those before it."""

    def __init__(self, spark: SparkSession, sf: str, k: int):
        self.k = k
        self.obs, self.reading = fx.survey(spark, sf)

    @cached_property
    def split(self) -> DataFrame:
        # Narrow, and counted and joined several times: written once.
        return materialize(splits.split_5_1(self.obs), "split_5_1")

    @cached_property
    def neighbors(self) -> DataFrame:
        train = self.split.filter(F.col("split") == "train").select("obs_id")
        test = self.split.filter(F.col("split") == "test").select("obs_id")
        return knn.knn_neighbors(test, train, self.reading, k=self.k)

    @cached_property
    def wide(self) -> DataFrame:
        """(obs_id, building_id, floor, longitude, latitude) as predicted."""
        labels = self.obs.select("obs_id", *CLASS_TARGETS, *REG_TARGETS)
        return knn.knn_predict(self.neighbors, labels, CLASS_TARGETS, REG_TARGETS)

    @property
    def predictions(self) -> dict[str, DataFrame]:
        return {t: self.wide.select("obs_id", F.col(t).alias("prediction")) for t in (*CLASS_TARGETS, *REG_TARGETS)}

    @cached_property
    def scored(self) -> DataFrame:
        tests = self.split.filter(F.col("split").isin("test", "hard_test"))
        return evaluate.scored_wide(self.wide, self.obs, (*CLASS_TARGETS, *REG_TARGETS), tests)


def knn_run(spark: SparkSession, sf: str, k: int = knn.K) -> KnnRun:
    return KnnRun(spark, sf, k)


@dataclass
class MlData:
    obs: DataFrame
    reading: DataFrame
    split: DataFrame
    index: DataFrame
    n_features: int
    train: DataFrame
    test: DataFrame


def ml_data(spark: SparkSession, sf: str) -> MlData:
    """Feature vectors and labels for the 5:1 split. The AP index is the AP
    catalogue (an AP no training scan heard is a constant zero feature, which
    tree learners never split on). The vector tables are written to the shared
    folder, so learners that pass over them many times reread a small table and
    nothing stays in executor memory between queries."""
    obs, reading = fx.survey(spark, sf)
    sp = materialize(splits.split_5_1(obs), "split_5_1")
    train_ids = sp.filter(F.col("split") == "train").select("obs_id")
    test_ids = sp.filter(F.col("split") == "test").select("obs_id")
    index = features.ap_index(fx.ap(spark, sf))
    n = index.count()
    train = features.labeled_vectors(obs, train_ids, reading, index, n)
    test = features.labeled_vectors(obs, test_ids, reading, index, n)
    return MlData(obs, reading, sp, index, n, train, test)


@dataclass
class Tuned:
    predictions: DataFrame
    report: DataFrame


def watch_set(d: MlData) -> DataFrame:
    """The part of the test set from the validation survey; it stops boosting."""
    hard = d.split.filter(F.col("split") == "hard_test").select("obs_id")
    return d.test.join(hard, "obs_id", "left_semi")


def tuned(spark: SparkSession, sf: str) -> Tuned:
    """The whole tuned flow on the 5:1 split: search for the floor forest and for
    both boosted coordinates, each on all training rows, the best models evaluated, the best parameters
    refitted on all labelled rows (``train_final``), evaluated again, and the
    unlabeled scans predicted."""
    from radiomap.plans import queries as q

    d = ml_data(spark, sf)
    watch = watch_set(d)
    final = features.labeled_vectors(d.obs, d.split.filter(F.col("split") == "train_final").select("obs_id"),
                                     d.reading, d.index, d.n_features)
    unlabeled = features.feature_vectors(d.obs.filter(F.col("dataset") == "test"), d.reading, d.index, d.n_features)
    tests = d.split.filter(F.col("split").isin("test", "hard_test"))
    labels = d.obs.select("obs_id", "floor", *REG_TARGETS)

    est = SparseForest.of(models.rf_classifier("floor"))
    found = search.tune(est, q.FOREST_GRID, d.train, "floor", q.FOREST_DRAWS, q.FOLDS)
    first = {"floor": models.score(found.model, d.test, "floor")}
    last = models.fit(est.copy(found.params), final, "floor")
    refit = {"floor": models.score(last, d.test, "floor")}
    out = models.score(last, unlabeled, FLOOR_MODEL)
    for t in REG_TARGETS:
        got = search.tune_boosted(q.BOOSTED_GRID, d.train, watch, t, q.BOOSTED_DRAWS, q.FOLDS)
        model = StagedBooster(t, watch).copy(got.params).fit(final)
        first[t] = models.score(got.model, d.test, t)
        refit[t] = models.score(model, d.test, t)
        out = out.join(models.score(model, unlabeled, f"{t}_boosted_5_1_final"), "obs_id")
    report = None
    for stage, made in (("search", first), ("final", refit)):
        wide = made["floor"]
        for t in REG_TARGETS:
            wide = wide.join(made[t], "obs_id")
        scored = materialize(evaluate.scored_wide(wide, labels, ("floor", *REG_TARGETS), tests), "tuned-scored")
        rows = evaluate.evaluation_report(scored, ("floor",), REG_TARGETS).withColumn("stage", F.lit(stage))
        report = rows if report is None else report.unionByName(rows)
    return Tuned(out, report)


def scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """(scenario, obs_id, building_id, floor, longitude, latitude) for the unlabeled
    scans in five scenarios. Sample 1 is the training side of ``split_half_val``,
    sample 2 that of ``split_sample2``; models with further inputs train on true
    values and score on the predicted ones. Boosting stops on a tenth of the
    sample, drawn by a hash, that it does not train on."""
    obs, reading = fx.survey(spark, sf)
    index = features.ap_index(fx.ap(spark, sf))
    n = index.count()
    unlabeled = features.feature_vectors(obs.filter(F.col("dataset") == "test"), reading, index, n)
    half = materialize(splits.split_half_val(obs), "split_half_val")
    second = materialize(splits.split_sample2(obs), "split_sample2")
    labels = obs.select("obs_id", *CLASS_TARGETS, *REG_TARGETS)
    out = None
    for sample, split in ((1, half), (2, second)):
        ids = split.filter(F.col("split") == "train").select("obs_id")
        train = features.labeled_vectors(obs, ids, reading, index, n)
        watched = hash_uniform(42, F.lit("watch"), "obs_id") < WATCHED
        watch, rest = train.filter(watched), train.filter(~watched)
        near = knn.knn_neighbors(unlabeled, ids, reading)
        building = materialize(knn.knn_predict(near, labels, ("building_id",)).withColumn(
            "building_id", F.col("building_id").cast("double")), "scenario-building")
        given = unlabeled.join(building, "obs_id")

        def boosted(target, more, rows, train=rest, watch=watch, classify=False):
            wide = lambda df: models.with_inputs(df, more, "_fx") if more else df
            used = "_fx" if more else "features"
            m = (boosted_classes(wide(train), wide(watch), target, used) if classify
                 else StagedBooster(target, wide(watch), used).fit(wide(train)))
            return materialize(models.score(m, wide(rows), target), f"scenario-{target}")

        def forest(target, more, rows, train=train):
            wide = lambda df: models.with_inputs(df, more, "_fx") if more else df
            make = models.rf_classifier if target in CLASS_TARGETS else models.rf_regressor
            m = models.fit(make(target, features="_fx" if more else "features"), wide(train), target)
            return materialize(models.score(m, wide(rows), target), f"scenario-{target}")

        floor = forest("floor", [], given) if sample == 1 else boosted("floor", [], given, classify=True)
        longitude = boosted("longitude", ["building_id"], given)
        ways = [(longitude, boosted("latitude", ["building_id"], given)),
                (longitude, boosted("latitude", ["building_id", "longitude"], given.join(longitude, "obs_id")))]
        if sample == 2:
            ways.append((forest("longitude", ["building_id"], given), forest("latitude", ["building_id"], given)))
        for k, (lon, lat) in enumerate(ways):
            rows = building.join(floor, "obs_id").join(lon, "obs_id").join(lat, "obs_id").select(
                F.lit(f"prediction_{2 * sample - 1 + k}").alias("scenario"), "obs_id", *CLASS_TARGETS, *REG_TARGETS)
            out = rows if out is None else out.unionByName(rows)
    return out


def rank_forest(spark: SparkSession, sf: str, trees: int = 5, k: int = rank.TOP_K) -> DataFrame:
    """(obs_id, actual, predicted) floor codes of the validation scans, by a forest
    on the one-hot ranks of the k strongest APs; one code table for both sides."""
    obs, reading = fx.survey(spark, sf)
    hot = materialize(reshape.one_hot_ranks(rank.topk_signals(reading, k=k), k=k).select("obs_id", "feature"), "one-hot")
    index = row_index(hot.select("feature").distinct(), ["feature"], name="idx", start=0).withColumn("idx", F.col("idx").cast("int"))
    n = index.count()
    entries = hot.join(index, "feature").groupBy("obs_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", F.lit(1.0).alias("x")))).alias("_entries"))
    labeled = obs.filter(F.col("dataset") != "test").select("obs_id", "dataset", "floor")
    codes = reshape.factorize(labeled.filter(F.col("dataset") == "train"), "floor")
    rows = reshape.apply_codes(labeled, codes, "floor").select("obs_id", "dataset", F.col("code").cast("double").alias("code"))
    vectors = features.as_vectors(rows.join(entries, "obs_id", "left"), n)
    model = models.fit(models.rf_classifier("code", num_trees=trees, max_depth=models.MAX_TREE_DEPTH),
                       vectors.filter(F.col("dataset") == "train"), "code")
    return model.transform(vectors.filter(F.col("dataset") == "val")).select(
        "obs_id", F.col("code").cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted"))


def model_gates(spark: SparkSession, sf: str) -> DataFrame:
    """(model, target, n_scored, n_missing, baseline, beats): every kind of model
    on the test set against always answering the commonest class, or the mean, of
    the training rows (ties: the smallest class)."""
    d = ml_data(spark, sf)
    watch = watch_set(d)
    kinds = [("forest", "building_id", models.rf_classifier("building_id")), ("forest", "longitude", models.rf_regressor("longitude")),
             ("svm", "building_id", models.svm_classifier("building_id"))]
    made = [(k, t, models.score(models.fit(e, d.train, t), d.test, "p")) for k, t, e in kinds]
    for t in ("building_id", "longitude"):  # the fixture's latitude does not depend on the signals
        m = boosted_classes(d.train, watch, t) if t in CLASS_TARGETS else StagedBooster(t, watch).fit(d.train)
        made.append(("boosted", t, models.score(m, d.test, "p")))
    chain = models.cascade(d.train, d.test, [("building_id", lambda t, f: models.rf_classifier(t, features=f)),
                                             ("longitude", lambda t, f: models.rf_regressor(t, features=f))])
    made.append(("cascade", "longitude", chain.select("obs_id", F.col("longitude_pred").alias("p"))))
    out = None
    for kind, t, p in made:
        y = F.col(t)
        base = d.train.agg((F.mode(t, True) if t in CLASS_TARGETS else F.avg(t)).alias("b")).first()["b"]
        off = (lambda x: (x != y).cast("double")) if t in CLASS_TARGETS else (lambda x: F.abs(x - y))  # noqa: B023
        row = d.test.select("obs_id", t).join(p, "obs_id", "left").agg(
            F.lit(kind).alias("model"), F.lit(t).alias("target"), F.count(F.lit(1)).alias("n_scored"),
            F.sum(F.col("p").isNull().cast("long")).alias("n_missing"), F.round(F.avg(off(F.lit(base))), 6).alias("baseline"),
            (F.avg(off(F.col("p"))) < F.avg(off(F.lit(base)))).alias("beats"))
        out = row if out is None else out.unionByName(row)
    return out
