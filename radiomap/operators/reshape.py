"""Reshape and encode: wide<->long, rank pivot, one-hot, factorize, unions,
location de-duplication and duplicate scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiomap.functions.signal import NOT_HEARD, sentinel_to_null
from radiomap.operators.clean import heard_pairs, with_dataset
from radiomap.operators.indexing import row_index
from radiomap.operators.rank import TOP_K
from radiomap.session import materialize

LABEL_ORDER = ("building_id", "floor", "longitude", "latitude")


def wide_to_long(df: DataFrame, id_cols, ap_cols, sentinel: int | None = NOT_HEARD) -> DataFrame:
    """Unpivot AP columns into (ids..., ap_id, rssi), keeping heard values only.

    AP columns are listed explicitly, so id columns can never turn into false
    APs. A row that hears nothing is left out before it is spread over its columns."""
    heard = [F.col(c).isNotNull() if sentinel is None else F.col(c) != sentinel for c in ap_cols]
    if heard:
        df = df.filter(reduce(lambda a, b: a | b, heard))
    if sentinel is not None:
        df = sentinel_to_null(df, ap_cols, sentinel)
    return (df.unpivot(list(id_cols), list(ap_cols), "ap_id", "rssi")
            .filter(F.col("rssi").isNotNull()))


def long_to_wide(reading: DataFrame, ap_ids, value: str = "rssi", fill=None) -> DataFrame:
    """Pivot readings to one column per AP (inverse of :func:`wide_to_long`).

    ``ap_ids`` fixes the columns. A catalogue too long for columns is laid out in
    panels (``fixtures.panels``) or as sparse vectors (``features``)."""
    wide = reading.groupBy("obs_id").pivot("ap_id", list(ap_ids)).agg(F.max(value))
    if fill is not None:
        wide = wide.fillna(fill, subset=[c for c in wide.columns if c != "obs_id"])
    return wide


def pivot_ranks(ranked: DataFrame, k: int = TOP_K, prefix: str = "hi") -> DataFrame:
    """(obs_id, hi1..hik): the AP at each rank; NULL where a scan has fewer APs."""
    wide = (ranked.filter(F.col("rn") <= k).groupBy("obs_id")
            .pivot("rn", list(range(1, k + 1))).agg(F.max("ap_id")))
    return wide.select("obs_id", *[F.col(str(i)).alias(f"{prefix}{i}") for i in range(1, k + 1)])


def one_hot_ranks(ranked: DataFrame, k: int = TOP_K, prefix: str = "hi") -> DataFrame:
    """Sparse one-hot of rank columns: (obs_id, feature = 'hi<rank><ap>', value = 1)."""
    return ranked.filter(F.col("rn") <= k).select(
        "obs_id",
        F.concat(F.lit(prefix), F.col("rn").cast("string"), F.col("ap_id")).alias("feature"),
        F.lit(1).alias("value"))


def factorize(df: DataFrame, column: str, order_col: str = "obs_id") -> DataFrame:
    """Integer codes 0, 1, ... by first appearance (smallest ``order_col``).

    NULL is not a category. The code table is numbered with the distributed
    row index, so a high-cardinality column never lands in a single task."""
    first = (df.filter(F.col(column).isNotNull()).groupBy(column)
             .agg(F.min(order_col).alias("_first")))
    coded = row_index(first, ["_first", column], name="_code", start=0)
    return coded.select(column, F.col("_code").cast("int").alias("code"))


def apply_codes(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """Attach codes fitted elsewhere; values unseen there get a NULL code."""
    return df.join(codes, column, "left")


def union_surveys(*frames: DataFrame) -> DataFrame:
    """Union by column name; columns missing from one survey become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def reorder_labels(obs: DataFrame, first=LABEL_ORDER) -> DataFrame:
    rest = [c for c in obs.columns if c not in first]
    return obs.select(*[c for c in first if c in obs.columns], *rest)


def distinct_locations(obs: DataFrame, carry=("building_id", "floor")) -> DataFrame:
    """One row per (latitude, longitude): the scan with the smallest obs_id.

    ``min(struct(obs_id, ...))`` aggregates partially on the map side, so a
    location visited by a third of all scans does not end up in one task."""
    first = F.min(F.struct("obs_id", *carry)).alias("_first")
    return (obs.groupBy("longitude", "latitude").agg(first)
            .select("longitude", "latitude", "_first.obs_id", *[f"_first.{c}" for c in carry]))


def all_locations(obs: DataFrame, datasets=("train", "val")) -> DataFrame:
    """Distinct locations of each labeled survey, tagged and unioned."""
    parts = [distinct_locations(obs.filter(F.col("dataset") == d)).withColumn("dataset", F.lit(d))
             for d in datasets]
    return union_surveys(*parts)


def common_aps(obs: DataFrame, reading: DataFrame, left: str = "train", right: str = "val") -> DataFrame:
    """APs heard in both datasets (set intersection), from one pass."""
    heard = heard_pairs(obs, reading).filter(F.col("dataset").isin(left, right))
    return heard.groupBy("ap_id").agg(F.count_distinct("dataset").alias("_n")).filter(F.col("_n") == 2).select("ap_id")


def ap_overlap_buildings(obs: DataFrame, reading: DataFrame) -> DataFrame:
    """For each pair of buildings, the number of APs heard in both.

    The self-join is on AP and pairs buildings that share it: an AP is heard in
    a handful of buildings, so it yields a few rows per AP, not all pairs of
    readings."""
    bap = (with_dataset(reading, obs, "building_id").filter(F.col("building_id").isNotNull())
           .select("building_id", "ap_id").distinct())
    a = bap.select(F.col("building_id").alias("building_a"), "ap_id")
    b = bap.select(F.col("building_id").alias("building_b"), "ap_id")
    return (a.join(b, "ap_id").filter(F.col("building_a") < F.col("building_b"))
            .groupBy("building_a", "building_b").agg(F.count(F.lit(1)).alias("n_common")))


# The narrower test: the same place in the same survey, whoever scanned it when.
PLACE_COLS = ("dataset", "building_id", "floor", "longitude", "latitude")
DUPLICATE_SALTS = 64


def duplicate_scans(obs: DataFrame, reading: DataFrame, cols=None) -> DataFrame:
    """Scans whose signals and attributes equal another scan's.

    Returns (obs_id, n_copies, keep) for every scan in a group of two or more;
    ``keep`` marks the first (smallest obs_id), which ``drop_duplicates`` keeps.
    ``cols`` are the attributes compared, by default every column but obs_id.
    A scan's signature is a SHA-256 of its attributes and its readings sorted by
    AP (bounded by the APs one scan hears), as one struct in JSON, where nulls,
    separators and numbers can't run into each other. Groups are counted with
    partial aggregation and joined back on (signature, salt), the few rows of
    the groups repeated for each salt, so one huge group is dealt over
    ``DUPLICATE_SALTS`` tasks."""
    cols = [c for c in obs.columns if c != "obs_id"] if cols is None else list(cols)
    heard = (reading.groupBy("obs_id")
             .agg(F.array_sort(F.collect_list(F.struct("ap_id", "rssi"))).alias("__heard")))
    whole = F.to_json(F.struct(F.struct(*[F.col(c) for c in cols]).alias("a"), F.col("__heard").alias("h")),
                      {"ignoreNullFields": "false"})
    # Narrow (obs_id, sig) table used twice below: written once so the
    # readings are not scanned and grouped a second time.
    sig = materialize(obs.join(heard, "obs_id", "left").select("obs_id", F.sha2(whole, 256).alias("sig")),
                      "scan_signatures")
    groups = (sig.groupBy("sig").agg(F.count(F.lit(1)).alias("n_copies"), F.min("obs_id").alias("first_id"))
              .filter(F.col("n_copies") > 1)
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(DUPLICATE_SALTS - 1)))))
    salted = sig.withColumn("salt", F.pmod(F.xxhash64("obs_id"), F.lit(DUPLICATE_SALTS)).cast("int"))
    return salted.join(groups, ["sig", "salt"]).select(
        "obs_id", F.col("n_copies").cast("bigint").alias("n_copies"),
        (F.col("obs_id") == F.col("first_id")).alias("keep"))


def drop_duplicate_scans(obs: DataFrame, reading: DataFrame, cols=None) -> DataFrame:
    """``drop_duplicates``: keep the first scan of every group of copies."""
    dup = duplicate_scans(obs, reading, cols).filter(~F.col("keep")).select("obs_id")
    return obs.join(dup, "obs_id", "left_anti")
