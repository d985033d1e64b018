"""A forest with its own bags, and its out-of-bag score.

Spark ML's forests don't tell which rows a tree has not seen. Here the bag is a
function of the tree and the row: a scan is in tree t as often as a Poisson(1) draw from
the hash of (seed, t, obs_id) says. So the bag table can be written down, recounted
in SQL, and is the same on every run. The trees are those of one forest (``sparse_trees``)
with a random subset of the features at every split, fitted on these bags by weights.
"""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiomap.functions.hashing import hash_uniform
from radiomap.operators.models import MAX_TREE_DEPTH, SEED, stable_layout
from radiomap.operators.sampling import poisson_copies
from radiomap.operators.sparse_trees import fit_forest
from radiomap.session import materialize

SALT = "bag"


def copies(tree, seed: int = SEED, id_col: str = "obs_id"):
    """How often a tree (a number or a column) sees a row."""
    return poisson_copies(hash_uniform(seed, F.lit(SALT), tree if not isinstance(tree, int) else F.lit(tree), id_col), 1.0)


def bag_table(rows: DataFrame, trees: int, seed: int = SEED, id_col: str = "obs_id") -> DataFrame:
    """(tree, id, copies): every tree with every row; 0 copies: out of the tree's bag."""
    every = rows.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), id_col)
    return every.withColumn("copies", copies(F.col("tree"), seed, id_col).cast("int"))


def fit_bagged(train: DataFrame, label: str, trees: int = 100, max_depth: int = 10, seed: int = SEED,
               features: str = "features") -> tuple[list[DecisionTreeClassificationModel], DataFrame]:
    """(one model a tree, the labelled rows that they were fitted on).

    All trees are grown in the same passes. Rows without a label are left out; a tree
    whose bag is empty is an error."""
    labelled = train.filter(F.col(label).isNotNull()).select("obs_id", features, F.col(label).cast("double").alias(label))
    data = materialize(stable_layout(labelled), "bagged")
    every = F.array(*[copies(t, seed).cast("tinyint") for t in range(trees)])
    make = RandomForestClassifier(labelCol=label, featuresCol=features, numTrees=trees, featureSubsetStrategy="sqrt",
                                  maxDepth=min(max_depth, MAX_TREE_DEPTH), seed=seed)
    return list(fit_forest(make, data.withColumn("_bags", every), "_bags").trees), data


def out_of_bag_votes(models: list[DecisionTreeClassificationModel], data: DataFrame, seed: int = SEED) -> DataFrame:
    """(tree, obs_id, vote): what each tree says of the rows that it has not seen."""
    votes = None
    for tree, model in enumerate(models):
        own = model.transform(data.filter(copies(tree, seed) == 0)).select(F.lit(tree).alias("tree"), "obs_id", F.col("prediction").alias("vote"))
        votes = own if votes is None else votes.unionByName(own)
    return materialize(votes, "oob-votes")


def out_of_bag(votes: DataFrame, data: DataFrame, label: str) -> DataFrame:
    """(obs_id, label, votes, predicted) for each row that some tree has not seen: the
    vote cast most often, the smaller class in a tie."""
    tally = votes.groupBy("obs_id", "vote").agg(F.count(F.lit(1)).alias("_c"))
    best = tally.groupBy("obs_id").agg(F.sum("_c").alias("votes"), F.max(F.struct("_c", (-F.col("vote")).alias("v"))).alias("_b"))
    return best.join(data.select("obs_id", label), "obs_id").select(
        "obs_id", label, "votes", (-F.col("_b.v")).alias("predicted"))


def out_of_bag_score(votes: DataFrame, data: DataFrame, label: str) -> DataFrame:
    """One row: rows scored, their votes, those right, the accuracy."""
    right = F.count(F.when(F.col("predicted") == F.col(label), 1))
    return out_of_bag(votes, data, label).agg(
        F.count(F.lit(1)).alias("n_scored"), F.coalesce(F.sum("votes"), F.lit(0)).alias("n_votes"), right.alias("n_right"),
        F.try_divide(right, F.count(F.lit(1))).alias("score"))
