"""Distributed training and scoring with Spark ML.

Forests are Spark ML models grown from the entries of sparse vectors (``sparse_trees``);
``boosted`` fits the boosters of the queries in the same way. Those made here and linear SVMs come
from ``pyspark.ml``; multi-class boosting and SVM use one-vs-rest. Training input is laid out deterministically
(hash-partitioned on obs_id and sorted, as many partitions as its rows need), so
a seeded forest gives the same model on every run regardless of how the input
arrived. A cascade chains models: true labels feed the next stage in training,
predicted ones in scoring, all columns of one row, without a join.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiomap.operators import sparse_trees
from radiomap.operators.features import standard_scaler
from radiomap.session import materialize

SEED = 42
ROWS_PER_TASK = 2_000  # training rows for which one more partition is laid out
MAX_TREE_DEPTH = 30  # Spark's limit; deeper settings are capped
OVR_PARALLELISM = 4  # per-class binary models fitted as concurrent Spark jobs


def train_partitions(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_TASK))


def linear_partitions(rows: int, width: int) -> int:
    """Partitions for a linear model over ``width`` inputs. Each sends a gradient of that width in
    every step, whatever its rows hold, so it has at least as many rows: what a step sends grows
    with the rows and not with rows x inputs."""
    return max(1, -(-rows // max(ROWS_PER_TASK, width)))


def stable_layout(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Partitioning and order that depend on the rows alone, so that seeded
    training is reproducible; the partition count follows the number of rows."""
    n = partitions or train_partitions(df.count())
    return df.repartition(n, "obs_id").sortWithinPartitions("obs_id")


def rf_classifier(label: str, num_trees: int = 100, max_depth: int = 10, seed: int = SEED,
                  feature_subset: str = "auto", features: str = "features") -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, featuresCol=features, numTrees=num_trees,
                                  maxDepth=min(max_depth, MAX_TREE_DEPTH), seed=seed,
                                  featureSubsetStrategy=feature_subset)


def rf_regressor(label: str, num_trees: int = 200, max_depth: int = 10, seed: int = SEED,
                 features: str = "features") -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=label, featuresCol=features, numTrees=num_trees,
                                 maxDepth=min(max_depth, MAX_TREE_DEPTH), seed=seed)


def gbt_regressor(label: str, max_iter: int = 20, max_depth: int = 5, step: float = 0.3,
                  min_info_gain: float = 0.0, seed: int = SEED, features: str = "features") -> GBTRegressor:
    return GBTRegressor(labelCol=label, featuresCol=features, maxIter=max_iter,
                        maxDepth=min(max_depth, MAX_TREE_DEPTH), stepSize=step, minInfoGain=min_info_gain,
                        lossType="squared", seed=seed)


def gbt_classifier(label: str, max_iter: int = 10, max_depth: int = 5, step: float = 0.3,
                   seed: int = SEED, features: str = "features") -> OneVsRest:
    """Multi-class boosting: one binary GBT per class (GBTClassifier is binary)."""
    base = GBTClassifier(featuresCol=features, maxIter=max_iter, maxDepth=min(max_depth, MAX_TREE_DEPTH),
                         stepSize=step, seed=seed)
    return OneVsRest(classifier=base, labelCol=label, featuresCol=features, parallelism=OVR_PARALLELISM)


def svm_classifier(label: str, max_iter: int = 10_000, reg: float = 0.01, tol: float = 1e-4,
                   features: str = "features") -> Pipeline:
    """Scale to unit variance, then one-vs-rest linear SVM (hinge loss); ``max_iter`` is the
    surveyed limit, ``tol`` ends the fit before it. Vectors are not centred, so they
    stay sparse: the intercept is free of the penalty and takes up the means, which
    leaves the fitted planes the same."""
    scaler = standard_scaler(features, "_scaled")
    ovr = OneVsRest(classifier=LinearSVC(maxIter=max_iter, regParam=reg, tol=tol), labelCol=label, featuresCol="_scaled",
                    parallelism=OVR_PARALLELISM)
    return Pipeline(stages=[scaler, ovr])


def fit(estimator, train: DataFrame, label: str) -> PipelineModel:
    """Fit on rows with a label, in a stable layout; always returns a PipelineModel."""
    rows = train.filter(F.col(label).isNotNull())
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else [estimator]
    width = _linear_width(stages, rows)
    data = stable_layout(rows, linear_partitions(rows.count(), width) if width else None)
    last = stages[-1]
    if len(stages) == 1 and isinstance(last, RandomForestClassifier | RandomForestRegressor) and sparse_trees.supported(last):
        return PipelineModel([sparse_trees.fit_forest(last, data)])
    return Pipeline(stages=stages).fit(data)


def _linear_width(stages: list, rows: DataFrame) -> int:
    """Inputs of the linear model behind a scaler that ``stages`` are; 0 for other models."""
    last = stages[-1]
    if not (isinstance(last, OneVsRest) and isinstance(last.getClassifier(), LinearSVC) and isinstance(stages[0], StandardScaler)):
        return 0
    one = rows.select(stages[0].getInputCol()).first()
    return one[0].size if one and one[0] is not None else 0


def score(model: PipelineModel, df: DataFrame, name: str = "prediction") -> DataFrame:
    """(obs_id, prediction) for every row of ``df``."""
    return model.transform(df).select("obs_id", F.col("prediction").alias(name))


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def model_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at ``path``, asked of the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load_or_fit(path: str, estimator, train: DataFrame, label: str) -> PipelineModel:
    """Load the model saved at ``path``; if nothing is there, fit and save it.

    What is there but can't be loaded raises and is left as it is."""
    if not model_exists(train.sparkSession, path):
        fit(estimator, train, label).write().save(path)
    return PipelineModel.load(path)


def feature_importance(model: PipelineModel, index: DataFrame) -> DataFrame:
    """(ap_id, importance) from a tree model's importances (one value per AP)."""
    used = model.stages[-1].featureImportances  # sparse: the APs that the trees split on
    vals = index.sparkSession.createDataFrame(
        [(int(i), float(v)) for i, v in zip(used.indices, used.values, strict=True)], "idx int, importance double")
    return index.join(vals, "idx", "left").select("ap_id", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def describe(model: PipelineModel) -> dict:
    """What a fitted tree model is made of: its trees, classes and inputs."""
    tree = model.stages[-1]
    return {"model": type(tree).__name__, "trees": int(tree.getNumTrees), "classes": int(getattr(tree, "numClasses", 0)),
            "features": int(tree.numFeatures), "nodes": int(tree.totalNumNodes),
            "depth": max(int(t.depth) for t in tree.trees)}


def tree_table(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """(tree, node, ap_id, threshold, left_node, right_node, prediction): the nodes of the
    forest saved at ``path`` as a relation. A scan goes left if the AP's value is at
    most ``threshold``; leaves have neither AP nor children. Node 0 is the root."""
    n = F.col("nodeData")
    nodes = spark.read.parquet(f"{path.rstrip('/')}/stages/*/data").select(
        F.col("treeID").alias("tree"), n.id.alias("node"), n.split.featureIndex.alias("idx"),
        F.get(n.split.leftCategoriesOrThreshold, F.lit(0)).alias("threshold"), n.leftChild.alias("l"), n.rightChild.alias("r"), n.prediction.alias("prediction"))
    child = lambda c: F.when(F.col(c) >= 0, F.col(c))
    return nodes.join(index.select("idx", "ap_id"), "idx", "left").select(
        "tree", "node", "ap_id", "threshold", child("l").alias("left_node"), child("r").alias("right_node"), "prediction")


def score_by_trees(trees: DataFrame, scans: DataFrame, entries: DataFrame, depth: int) -> DataFrame:
    """(obs_id, prediction): the mean over all trees of the leaf that a scan comes to, by
    joins alone. ``scans`` (obs_id), ``entries`` (obs_id, ap_id, x; absent: 0); ``depth`` is
    that of the deepest tree. A scan stands in one node of each tree, so rows never grow."""
    roots = trees.where("node = 0").select("tree").agg(F.array_sort(F.collect_list("tree")).alias("t"))  # one number a tree
    numbers = roots.first()["t"]
    at = scans.select("obs_id", F.explode(F.array(*[F.lit(t) for t in numbers])).alias("tree"), F.lit(0).alias("node"))
    for level in range(depth):
        here = at.join(trees.select("tree", "node", "ap_id", "threshold", "left_node", "right_node"), ["tree", "node"])
        value = F.coalesce("x", F.lit(0.0))
        below = F.when(value <= F.col("threshold"), F.col("left_node")).otherwise(F.col("right_node"))
        at = here.join(entries, ["obs_id", "ap_id"], "left").select(
            "obs_id", "tree", F.when(F.col("ap_id").isNull(), F.col("node")).otherwise(below).alias("node"))
        if level % 4 == 3:
            at = materialize(at, "tree-walk")
    leaf = at.join(trees.select("tree", "node", "prediction"), ["tree", "node"])
    return leaf.groupBy("obs_id").agg(F.avg("prediction").alias("prediction"))


def with_inputs(df: DataFrame, extra, out: str = "features_x", features: str = "features") -> DataFrame:
    """Append scalar columns (e.g. building, longitude) to the feature vector."""
    return VectorAssembler(inputCols=[features, *extra], outputCol=out).transform(df)


def cascade(train: DataFrame, test: DataFrame, stages, features: str = "features") -> DataFrame:
    """Chain of models: stage i predicts target_i from the features plus the
    targets of earlier stages. ``stages`` = [(target, estimator_factory)].
    Training uses true earlier targets; scoring uses predicted ones. Returns
    (obs_id, <target>_pred ...) for ``test``."""
    known: list[str] = []
    scored = test.select("obs_id", features)
    for target, make in stages:
        feats = features if not known else "_fx"
        tr = train if not known else with_inputs(train, known, "_fx", features)
        given = scored if not known else with_inputs(scored, [f"{c}_pred" for c in known], "_fx", features)
        done = fit(make(target, feats), tr, target).transform(given)
        known.append(target)
        scored = done.select("obs_id", features, *[f"{c}_pred" for c in known[:-1]],
                             F.col("prediction").alias(f"{target}_pred"))
    return scored.drop(features)
