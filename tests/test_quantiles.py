"""Distributed exact quantiles against DuckDB's quantile_cont."""

import math

import pytest

from conftest import SF_MID
from flowsift.functions.quantiles import exact_quantiles
from flowsift.sources.views import read_table


@pytest.mark.parametrize("method", ["select", "map"])
def test_global_and_grouped_quantiles(spark, method):
    import duckdb
    li = read_table(spark, SF_MID, "lineitem")
    cols, probs = ["l_extendedprice", "l_discount", "l_quantity"], [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r["column"], r["p"]): r["value"] for r in
           exact_quantiles(li, cols, probs, buckets=16, method=method).collect()}
    for c in cols:
        for p in probs:
            ref = duckdb.sql(f"SELECT quantile_cont({c}, {p}) FROM '{SF_MID}/lineitem.parquet'").fetchall()[0][0]
            assert math.isclose(got[(c, p)], ref, rel_tol=1e-12, abs_tol=1e-12), (c, p, got[(c, p)], ref)
    g = {(r["l_returnflag"], r["p"]): r["value"] for r in
         exact_quantiles(li, ["l_extendedprice"], [0.5, 0.3], keys=["l_returnflag"], buckets=8,
                         method=method).collect()}
    ref = duckdb.sql(f"""SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5), quantile_cont(l_extendedprice, 0.3)
                         FROM '{SF_MID}/lineitem.parquet' GROUP BY 1""").fetchall()
    for flag, m, q3 in ref:
        assert math.isclose(g[(flag, 0.5)], m, rel_tol=1e-12) and math.isclose(g[(flag, 0.3)], q3, rel_tol=1e-12)


def test_quantiles_with_nulls_and_tiny_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", 5.0), ("c", None)], "k string, x double")
    got = {(r["k"], r["p"]): r["value"] for r in
           exact_quantiles(df, ["x"], [0.5], keys=["k"], buckets=4, method="select").collect()}
    assert got[("a", 0.5)] == 2.0 and got[("b", 0.5)] == 5.0 and got.get(("c", 0.5)) is None


@pytest.mark.parametrize("name", ["describe_numeric", "impute_median_mode", "impute_group_median", "iqr_outliers",
                                  "clean_flows"])
def test_operators_on_the_selection_path(spark, duck_small, name):
    """Force the rank-selection path (no value maps) and compare with the oracle."""
    from check_oracle import compare
    from conftest import SF_SMALL
    spark.conf.set("flowsift.quantiles.mapLimit", "0")
    try:
        r = compare(spark, duck_small, name, SF_SMALL)
    finally:
        spark.conf.unset("flowsift.quantiles.mapLimit")
    assert r["ok"], r
