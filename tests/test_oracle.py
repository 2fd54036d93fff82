"""Every registered query against its DuckDB oracle (row count, names,
type family, order-insensitive value hash), at the smallest scale."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

NAMES = sorted(E.oracle_sql())


def test_every_query_reads_tables(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck_small, name):
    from check_oracle import compare
    r = compare(spark, duck_small, name, SF_SMALL)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) >= {"proto", "Benign", "Malicious"}
