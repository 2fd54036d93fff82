"""Profiling.

The reference scans the frame once per column and statistic. Here every
report is one aggregate over all columns (partial aggregation on the map
side, a single tiny final row), then turned into long form with ``inline``
on the executors; nothing but the final report reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.functions.columns import numeric_columns, string_columns
from flowsift.functions.quantiles import exact_quantiles
from flowsift.session import cut_lineage


def _is_float(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))


def _missing(df: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    return (col.isNull() | F.isnan(col)) if _is_float(df, c) else col.isNull()


def _long(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array(*structs)))


# C1
def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True,
                     accuracy: int = 100_000) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear interpolation), max per column.

    ``exact``: distributed exact quantiles (``functions.quantiles``);
    ``exact=False``: the quantile sketch, fused into the same single pass.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if not exact:
            aggs.append(F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), accuracy)
                        .alias(f"q{i}"))
    one = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
                        F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                        F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
                        *([F.col(f"q{i}")[j].cast("double").alias(f"q{int(p * 100)}")
                           for j, p in enumerate((0.25, 0.5, 0.75))] if not exact else []))
               for i, c in enumerate(cols)]
    base = _long(one, structs)
    if not exact:
        return base.select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])  # columns × 3 rows
    wide = q.groupBy("column").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"q{int(p * 100)}")
                                     for p in (0.25, 0.5, 0.75)])
    return (base.join(F.broadcast(wide), "column", "left")
            .select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"))


def column_profile(df: DataFrame) -> DataFrame:
    """One pass: rows, missing, blanks (text), zeros (numeric) for every column."""
    nums, texts = set(numeric_columns(df)), set(string_columns(df))
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        aggs.append(F.count_if(_missing(df, c)).alias(f"miss{i}"))
        aggs.append(F.count_if(F.trim(col) == "").alias(f"blank{i}") if c in texts
                    else F.lit(None).cast("bigint").alias(f"blank{i}"))
        aggs.append(F.count_if(col == 0).alias(f"zero{i}") if c in nums
                    else F.lit(None).cast("bigint").alias(f"zero{i}"))
    one = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                        F.col("rows"), F.col(f"miss{i}").alias("missing"),
                        F.col(f"blank{i}").alias("blanks"), F.col(f"zero{i}").alias("zeros"))
               for i, c in enumerate(df.columns)]
    return _long(one, structs)


def _pct(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num * 100.0, den), F.lit(0.0))


# C2
def missing_report(df: DataFrame) -> DataFrame:
    """column, missing, missing_pct (of rows); sorted by missing descending."""
    p = column_profile(df)
    return (p.select("column", "missing", _pct(F.col("missing"), F.col("rows")).alias("missing_pct"))
            .orderBy(F.desc("missing"), "column"))


def missing_summary(df: DataFrame) -> DataFrame:
    """total missing, share of all cells, number of columns with any missing."""
    p = column_profile(df)
    return p.agg(F.sum("missing").alias("total_missing"),
                 _pct(F.sum("missing"), F.max("rows") * F.count(F.lit(1))).alias("total_missing_pct"),
                 F.count_if(F.col("missing") > 0).alias("columns_with_missing"))


# C3
def blank_report(df: DataFrame) -> DataFrame:
    p = column_profile(df).filter(F.col("blanks").isNotNull())
    return p.select("column", "blanks", _pct(F.col("blanks"), F.col("rows")).alias("blank_pct"))


# C4
def zero_report(df: DataFrame) -> DataFrame:
    """Zeros per numeric column; share over all rows (NULL counts as non-zero)."""
    p = column_profile(df).filter(F.col("zeros").isNotNull())
    return p.select("column", "zeros", _pct(F.col("zeros"), F.col("rows")).alias("zero_pct"))


# C5 / C6 / C10
def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """value, count, pct. NULLs are not a value but stay in the denominator.

    One shuffle by value (map-side partial counts); the counts are written once
    and the total is taken from them, so the data is scanned once.
    """
    grouped = cut_lineage(df.groupBy(F.col(f"`{col}`").alias("value")).agg(F.count(F.lit(1)).alias("count")))
    total = grouped.agg(F.sum("count").alias("_total"))
    out = (grouped.filter(F.col("value").isNotNull()).crossJoin(F.broadcast(total))
           .select("value", "count", _pct(F.col("count"), F.col("_total")).alias("pct")))
    if top is not None:
        out = out.orderBy(F.desc("count"), F.asc("value")).limit(top)
    return out


# C7
def cardinality(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """column, n_distinct (NULL not counted). ``exact=False``: HyperLogLog++ (one pass, no expand).

    The exact form is two aggregations over narrow (column, value) rows, combined
    before the shuffle, so no task holds a column's values."""
    cols = list(cols) if cols is not None else list(df.columns)
    if not exact:
        one = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), 0.01).alias(f"d{i}") for i, c in enumerate(cols)])
        return _long(one, [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct"))
                           for i, c in enumerate(cols)])
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _text(df, c).alias("value")) for c in cols])))
    counts = (long.filter(F.col("value").isNotNull()).distinct()
              .groupBy("column").agg(F.count(F.lit(1)).alias("n")))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(F.broadcast(counts), "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("n_distinct"))


def _text(df: DataFrame, c: str) -> Column:
    """A column's value as text, equal for equal values (-0.0 is 0.0)."""
    x = F.col(f"`{c}`")
    return (x + 0.0 if df.schema[c].dataType.typeName() in ("double", "float") else x).cast("string")


# C8
def null_matrix(df: DataFrame, order_col: str, buckets: int = 100,
                cols: Sequence[str] | None = None) -> DataFrame:
    """Null share per (row bucket along ``order_col``, column): the data under
    a missing-value heat map, reduced to ``buckets`` rows."""
    cols = list(cols) if cols is not None else [c for c in df.columns if c != order_col]
    o = F.col(order_col).cast("double")
    rng = df.agg(F.min(o).alias("_lo"), F.max(o).alias("_hi"))
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
    b = F.least(F.floor((o - F.col("_lo")) / width * buckets), F.lit(buckets - 1)).cast("int")
    binned = df.crossJoin(F.broadcast(rng)).withColumn("bucket", b)
    wide = binned.groupBy("bucket").agg(*[F.avg(_missing(df, c).cast("double")).alias(f"z{i}")
                                          for i, c in enumerate(cols)])
    return wide.select("bucket", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"z{i}").alias("null_share")) for i, c in enumerate(cols)])))


# C9
def file_stats(df: DataFrame, file_col: str = "source_file", label: str = "label") -> DataFrame:
    """Per file: rows, malicious/benign counts and shares, columns with any
    missing value, missing cells. One grouped pass."""
    cols = [c for c in df.columns if c != file_col]
    g = df.groupBy(file_col).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(label) == "Malicious").alias("malicious"),
        F.count_if(F.col(label) == "Benign").alias("benign"),
        *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
    miss = [F.col(f"m{i}") for i in range(len(cols))]
    return g.select(
        file_col, "rows", "malicious", "benign",
        _pct(F.col("malicious"), F.col("rows")).alias("malicious_pct"),
        _pct(F.col("benign"), F.col("rows")).alias("benign_pct"),
        sum((F.when(m > 0, 1).otherwise(0) for m in miss), F.lit(0)).alias("columns_with_missing"),
        sum(miss, F.lit(0).cast("bigint")).alias("missing_total"))


# C11 / E10
def class_share(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """count and pct of each class within each ``by`` group (e.g. split)."""
    by = list(by)
    g = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("count"))
    # the window runs over the aggregated table (groups x classes rows), not the data
    total = F.sum("count").over(Window.partitionBy(*by)) if by else F.sum("count").over(Window.partitionBy())
    return g.select(*by, label, "count", _pct(F.col("count"), total).alias("pct"))
