"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from compare import compare
from hotspot.plans import all_queries, all_sql

from conftest import SMALL

QUERIES = all_queries()
SQL = all_sql()


def test_every_key_has_spark_and_sql():
    assert len(QUERIES) >= 90
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_oracle(spark, duck_small, key):
    r = compare(spark, duck_small, key, QUERIES[key], SQL.get(key), SMALL)
    assert r["status"] in ("ok", "rows-only"), r  # values and DuckDB column types


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() >= 0
    assert "speed" in df.columns
