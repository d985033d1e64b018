"""Row-wise signal expressions (all built-in, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the survey format: 100 marks "not heard" in the wide CSV,
# -110 dBm is the fill used where a formula needs a number for "not heard".
NOT_HEARD = 100
FILL_DBM = -110
STRONG_DBM = -30
OUTLIER_DBM = -29


def sentinel_to_null(df: DataFrame, signal_cols, sentinel: int = NOT_HEARD) -> DataFrame:
    """Replace the sentinel by NULL in the signal columns only (never in ids)."""
    cols = set(signal_cols)
    return df.select(*[F.nullif(F.col(c), F.lit(sentinel)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def fill_missing(df: DataFrame, signal_cols, value: int = FILL_DBM) -> DataFrame:
    """NULL -> fill value in the signal columns; label columns keep their NULLs."""
    return df.fillna(value, subset=list(signal_cols))


def sentinel_to_fill(df: DataFrame, signal_cols, sentinel: int = NOT_HEARD,
                     value: int = FILL_DBM) -> DataFrame:
    cols = set(signal_cols)
    return df.select(*[F.when(F.col(c) == sentinel, F.lit(value)).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def dbm_to_mw(rssi: Column) -> Column:
    """dBm -> milliwatt: 10 ** (dBm / 10)."""
    return F.pow(F.lit(10.0), rssi / F.lit(10.0))


def shifted(rssi: Column, fill: int = FILL_DBM) -> Column:
    """rssi - fill, so "not heard" is 0 (a sparse zero) and heard values are > 0."""
    return (rssi - F.lit(fill)).cast("bigint")


def ap_columns(df: DataFrame, prefix: str = "WAP") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]
