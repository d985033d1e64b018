"""Every query with oracle SQL gives the same rows, names and types as DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tools.oracle_check import compare

ORACLE = entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    problems, n_spark, n_duck = compare(df, duck, ORACLE[name])
    assert not problems, problems


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["ap_id", "min_lat", "max_lat", "min_lon", "max_lon", "lat_diff", "long_diff", "max_diff"]
