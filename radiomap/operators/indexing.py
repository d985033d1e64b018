"""Distributed running row index (``reset_index`` / ``row_number`` at scale).

A ``row_number()`` window partitioned by a low-cardinality key (the dataset
tag) or by nothing at all moves a whole group into one task. Instead the rows
are range-partitioned on (group, order) keys, numbered inside each partition,
and shifted by the row counts of the earlier partitions of the same group.
The per-partition counts table has at most (partitions + groups) rows.

The numbered frame is written to the shared checkpoint folder first, so both
uses of it see the same ids even if AQE coalesces shuffle reads differently
or an executor is lost and tasks rerun.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from radiomap.session import materialize

_PART_SHIFT = 33  # monotonically_increasing_id = partition << 33 | position


def row_index(df: DataFrame, order_cols, group_cols=(), name: str = "row_idx", start: int = 1,
              num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = position (from ``start``) of each row inside its group by
    ``order_cols``. The order keys must be unique within a group so that the
    numbering is deterministic."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    group_cols, order_cols = list(group_cols), list(order_cols)
    keys = group_cols + order_cols
    numbered = materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                           .withColumn("__ri_mid", F.monotonically_increasing_id()), "row_index")
    part = F.shiftright("__ri_mid", _PART_SHIFT)
    local = F.col("__ri_mid").bitwiseAND(F.lit((1 << _PART_SHIFT) - 1))
    numbered = numbered.withColumn("__ri_part", part).withColumn("__ri_local", local)
    counts = (numbered.groupBy("__ri_part", *group_cols)
              .agg(F.count(F.lit(1)).alias("__ri_cnt"), F.min("__ri_local").alias("__ri_first")))
    before = Window.partitionBy(*group_cols).orderBy("__ri_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__ri_part", *group_cols, "__ri_first",
                            F.coalesce(F.sum("__ri_cnt").over(before), F.lit(0)).alias("__ri_offset"))
    idx = F.col("__ri_offset") + (F.col("__ri_local") - F.col("__ri_first")) + F.lit(start)
    return (numbered.join(offsets, ["__ri_part", *group_cols])
            .select(*df.columns, idx.cast("bigint").alias(name)))
