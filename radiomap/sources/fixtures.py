"""Survey-shaped views derived by Spark from the driver's tables.

``truth`` (every scan with labels), ``ap`` (the AP catalogue), ``reading``
(long form, one row per heard (scan, AP)), ``obs`` (labels hidden for the
unlabeled ``test`` set) and ``scan_wide`` (the CSV shape with the 100
sentinel, the whole catalogue laid out in panels of 64 AP columns). They follow FIXTURES.md exactly, so the DuckDB oracle
can rebuild the same rows with the SQL in ``radiomap.plans.oracle``.

Scale notes: ``reading`` is a sort-merge join of lineitem with the scan table
on the order key (a ``merge`` hint: the line table is never the side to
broadcast, even when a file-size estimate says it is small) followed by an
aggregate on (obs_id, ap_id) that reuses the join's hash partitioning on
obs_id, so it adds no exchange; later per-scan windows, aggregates and joins
on obs_id reuse it too. The AP catalogue joins by broadcast when the planner's
size estimate allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiomap.session import materialize
from radiomap.sources.tables import table

LABELS = ("building_id", "floor", "longitude", "latitude")
CONTEXT = ("space_id", "relative_position", "user_id", "phone_id", "ts")
OBS_COLUMNS = ("obs_id", "dataset") + LABELS + CONTEXT

# Fixed values of the fixture definition (FIXTURES.md §3).
PANEL = 64
PANEL_LINES = 200_000  # rows of the line table for which one more partition of panels is laid out
WIDE_APS = tuple(f"AP_{i:02d}" for i in range(PANEL))
SENTINEL = 100


def _building(status: Column) -> Column:
    return F.when(status == "F", 0).when(status == "O", 1).otherwise(2)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
              "o_orderpriority", "o_orderdate")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    building = _building(F.col("o_orderstatus"))
    return j.select(
        key.alias("obs_id"),
        F.when(key % 10 == 0, "val").when(key % 10 == 1, "test").otherwise("train").alias("dataset"),
        building.alias("building_id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("floor"),
        ((F.lit(-7600) + F.lit(120) * building).cast("double")
         + (cust % 400).cast("double") / 4).alias("longitude"),
        (F.lit(4864750).cast("double") + (cust % 37).cast("double") * 2.5).alias("latitude"),
        (cust % 250).cast("int").alias("space_id"),
        (F.lit(1) + key % 2).cast("int").alias("relative_position"),
        (cust % 18).cast("int").alias("user_id"),
        F.col("c_nationkey").cast("int").alias("phone_id"),
        F.col("o_orderdate").alias("ts"),
    )


def ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AP catalogue: ``ap_no`` (supplier key) and its name ``ap_id``."""
    s = table(spark, sf_dir, "supplier", "s_suppkey")
    return s.select(
        F.col("s_suppkey").alias("ap_no"),
        ap_name(F.col("s_suppkey")).alias("ap_id"),
    )


def ap_name(number: Column) -> Column:
    """WAP and the number plus one, padded to four digits where it has fewer."""
    text = (number + 1).cast("string")
    return F.concat(F.lit("WAP"), F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text))


def ap_number(name: Column) -> Column:
    return F.substring(name, 4, 20).cast("bigint") - 1


def reading(spark: SparkSession, sf_dir: str, parts: int = 0) -> DataFrame:
    """Long form: one row per heard (obs_id, ap_id) with the strongest rssi; ``parts``: tasks
    that scans are dealt to, if not as many as Spark chooses."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_quantity")
    t = truth(spark, sf_dir).select("obs_id", "dataset", "building_id", "floor")
    if parts:
        li, t = li.repartition(parts, "l_orderkey"), t.repartition(parts, "obs_id")
    a = ap(spark, sf_dir)
    j = li.hint("merge").join(t, li.l_orderkey == t.obs_id).join(a, li.l_suppkey == a.ap_no)
    no = F.col("ap_no")
    audible = (
        ((no % 4 == 0) | (no % 4 == F.col("building_id") + 1))
        & ~((F.col("dataset") == "test") & (no % 5 == 3))
        & ~((F.col("dataset") == "val") & (no % 7 == 2))
    )
    ap_floor = F.floor(no / F.lit(4.0)).cast("int") % 5
    rssi = (-F.col("l_quantity")).cast("int") - 12 * F.abs(F.col("floor") - ap_floor)
    return (j.filter(audible)
            .groupBy("obs_id", "ap_id")
            .agg(F.max(rssi).alias("rssi")))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan table as operators may see it: labels NULL for the test set."""
    t = truth(spark, sf_dir)
    labeled = F.col("dataset") != "test"
    return t.select(
        "obs_id", "dataset",
        *[F.when(labeled, F.col(c)).alias(c) for c in LABELS],
        *CONTEXT,
    )


def panels(readings: DataFrame) -> DataFrame:
    """Readings pivoted into panels: (obs_id, panel, AP_00..AP_63), a row for each
    panel of consecutive AP numbers in which the scan hears one. The columns are
    the same for every catalogue; nothing is listed on the driver.
    ``panel_readings`` deals the readings out for this."""
    no = ap_number(F.col("ap_id"))
    r = readings.select("obs_id", "rssi", F.floor(no / F.lit(PANEL)).cast("int").alias("panel"),
                        F.pmod(no, F.lit(PANEL)).cast("int").alias("slot"))
    return r.groupBy("obs_id", "panel").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("rssi"))).alias(c) for i, c in enumerate(WIDE_APS)])


def panel_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as ``panels`` takes them. A task holds its panels while it fills them, each many
    times the size of its readings, so the tasks follow the rows of the line table. Left to itself,
    Spark merges the readings, small as they are when shuffled, down to a task for each core."""
    parts = -(-table(spark, sf_dir, "lineitem", "l_orderkey").count() // PANEL_LINES)  # one number to the driver
    return reading(spark, sf_dir, parts if parts > spark.sparkContext.defaultParallelism else 0)


def scan_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV shape over the whole catalogue: (obs_id, dataset, space_id, panel,
    AP_00..AP_63), a row for each scan and panel of 64 APs, 100 = not heard.

    Scans x panels is the size of the result; nothing of that size is shuffled. The
    heard panels join their scan by its id and are written once; the others are laid
    out where the scan is, from the panels that it does not hear."""
    last = ap(spark, sf_dir).agg(F.max("ap_no")).first()[0]  # one number to the driver
    every = F.sequence(F.lit(0), F.lit((last or 0) // PANEL).cast("int"))
    o = obs(spark, sf_dir).select("obs_id", "dataset", "space_id")
    heard = materialize(o.join(panels(panel_readings(spark, sf_dir)), "obs_id").filter(F.array_contains(every, F.col("panel"))).select(
        *o.columns, "panel", *[F.coalesce(F.col(c), F.lit(SENTINEL)).alias(c) for c in WIDE_APS]), "heard-panels")
    known = heard.groupBy("obs_id").agg(F.collect_set("panel").alias("_known"))
    silent = o.join(known, "obs_id", "left").select(
        *o.columns, F.explode(F.array_except(every, F.coalesce("_known", F.array().cast("array<int>")))).alias("panel"),
        *[F.lit(SENTINEL).alias(c) for c in WIDE_APS])
    return heard.unionByName(silent)


def survey(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(obs, reading) pair — the two tables most operators take."""
    return obs(spark, sf_dir), reading(spark, sf_dir)
