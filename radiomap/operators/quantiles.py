"""Quantiles of continuous columns, and the box plot built on them.

``sketch_quantiles`` is one aggregate whose partial states merge, with a stated
error. ``exact_quantiles`` uses that sketch to find, for each group, the narrow range
of values in which a quantile must lie; one more pass counts what lies below the
range, and only the values inside it are ordered. No group is ever collected
or sorted whole, however large it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from radiomap.session import materialize

ACCURACY = 10_000  # the sketch's rank error is at most rows / ACCURACY
QUARTILES = (0.25, 0.5, 0.75)


def sketch_quantiles(df: DataFrame, by, column: str, probs=QUARTILES, accuracy: int = ACCURACY) -> DataFrame:
    """(by.., n, quantiles): for each of ``probs`` a value of the group whose rank is off
    by at most n / ``accuracy``. Nulls don't count; a group of nulls only has n = 0 and null."""
    return df.groupBy(*by).agg(F.count(column).alias("n"),
                               F.percentile_approx(column, [float(p) for p in probs], accuracy).alias("quantiles"))


def exact_quantiles(df: DataFrame, by, column: str, probs=QUARTILES, accuracy: int = ACCURACY) -> DataFrame:
    """(by.., n, quantiles): quantiles by linear interpolation between the two values
    next to rank p (n - 1), exact at every size.

    The sketch is asked three of its errors below and above each p, which encloses
    both ranks for certain; up to ``accuracy`` rows a group's range is all of it. Equal
    values count as one row of the ordered part, which holds at most about 8 /
    ``accuracy`` of a larger group for each quantile. ``df`` is derived once: the narrow
    (by, value) table is written and read twice. Nulls don't count, groups
    without a value are left out; NaN is above all numbers."""
    by = list(by)
    source = df.select(*by, F.col(column).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    rows = materialize(source, "quantiles")
    reach = 3.0 / accuracy
    asked = [min(max(p + side * reach, 0.0), 1.0) for p in probs for side in (-1, 1)]
    sketch = rows.groupBy(*by).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                                   F.percentile_approx("_v", asked, accuracy).alias("_q"))
    small = F.col("_n") <= accuracy

    def edge(k: int, p: float, whole: str):
        outer = asked[k] in (0.0, 1.0)
        return F.col(whole) if outer else F.when(small, F.col(whole)).otherwise(F.get("_q", F.lit(k)))
    ranges = sketch.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_n"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), edge(2 * i, p, "_lo").alias("lo"), edge(2 * i + 1, p, "_hi").alias("hi"))
        for i, p in enumerate(probs)])).alias("_r"))
    bounds = ranges.groupBy(*[c for c in ranges.columns if c != "_r"]).agg(F.sort_array(F.collect_list("_r")).alias("_r"))
    # One pass: below each range a count, inside it the values with their counts.
    place = F.filter(F.col("_r"), lambda r: F.col("_v") <= r["hi"])
    seen = F.explode(F.transform(place, lambda r: F.struct(r["i"].alias("i"), r["p"].alias("p"), F.when(F.col("_v") >= r["lo"], F.col("_v")).alias("v"))))
    met = rows.join(bounds, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by])
    counts = met.select(*by, "_n", seen.alias("_s")).groupBy(*by, "_n", "_s").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_s.i").orderBy(F.col("_s.v").asc_nulls_first())
                            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = F.col("_s.p") * (F.col("_n") - 1)
    ranked = counts.select(*by, "_n", "_s", "_c", upto.alias("_upto")).filter(F.col("_s.v").isNotNull())
    holds = lambda rank: (F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto"))
    value = ranked.groupBy(*by, "_n", F.col("_s.i").alias("_i")).agg(
        F.first(F.when(holds(F.floor(at)), F.col("_s.v")), ignorenulls=True).alias("_a"),
        F.first(F.when(holds(F.ceil(at)), F.col("_s.v")), ignorenulls=True).alias("_b"),
        F.first(at - F.floor(at)).alias("_f"))
    point = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"))
    return (value.groupBy(*by, F.col("_n").alias("n"))
            .agg(F.sort_array(F.collect_list(F.struct("_i", point.alias("v")))).getField("v").alias("quantiles")))


def boxplot(df: DataFrame, by: str, column: str, whisker: float = 1.5, accuracy: int = ACCURACY) -> DataFrame:
    """Box plot of a continuous column by group: exact quartiles, whiskers at the
    outermost values within ``whisker`` interquartile ranges, the outliers beyond."""
    rows = df.select(by, F.col(column).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    q = exact_quantiles(rows, [by], "_v", QUARTILES, accuracy)
    quartile = [F.get("quantiles", F.lit(k)) for k in range(3)]
    span = whisker * (quartile[2] - quartile[0])
    fences = q.select(F.col(by).alias("_by"), "n", *[x.alias(c) for c, x in zip(("q1", "median", "q3"), quartile, strict=True)],
                      (quartile[0] - span).alias("_low"), (quartile[2] + span).alias("_high"))
    inside = (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
    return (rows.join(fences, F.col(by).eqNullSafe(F.col("_by"))).groupBy(by, "n", "q1", "median", "q3")
            .agg(F.min(F.when(inside, F.col("_v"))).alias("lower_whisker"), F.max(F.when(inside, F.col("_v"))).alias("upper_whisker"),
                 F.count(F.when(~inside, 1)).alias("n_outliers"))
            .select(by, "n", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "lower_whisker", "upper_whisker", "n_outliers"))
