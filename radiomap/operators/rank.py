"""Rank APs inside each scan (strongest or weakest first) and keep the top k.

Ties are broken by a seeded hash of (scan, AP), then by AP name: the same
random-looking but reproducible order on every run and in every engine. With
``k`` at most ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000) the
planner inserts a WindowGroupLimit before the shuffle, so only k rows per scan
per map task cross the network.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from radiomap.functions.hashing import hash_key

# The survey's seed and number of strongest signals kept.
SEED = 42
TOP_K = 10


def rank_signals(reading: DataFrame, seed: int = SEED, ascending: bool = False,
                 k: int | None = None) -> DataFrame:
    """(obs_id, rn, ap_id, rssi); rn = 1 is the strongest (or weakest) AP."""
    rssi = F.col("rssi").asc() if ascending else F.col("rssi").desc()
    w = Window.partitionBy("obs_id").orderBy(rssi, hash_key(seed, "obs_id", "ap_id"), F.col("ap_id"))
    ranked = reading.withColumn("rn", F.row_number().over(w))
    if k is not None:
        ranked = ranked.filter(F.col("rn") <= k)
    return ranked.select("obs_id", "rn", "ap_id", "rssi")


def topk_signals(reading: DataFrame, k: int = TOP_K, seed: int = SEED) -> DataFrame:
    return rank_signals(reading, seed=seed, k=k)
