"""Cleaning and imputation.

Column statistics are computed in one aggregate and applied through a
one-row broadcast (size is 1 by construction), so the cleaned frame stays a
lazy plan. Group statistics (D7) are joined after a row-count check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.functions.columns import numeric_columns, present, string_columns
from flowsift.functions.quantiles import MAP_LIMIT, exact_quantiles, quantile_row
from flowsift.operators.profile import _missing, column_profile
from flowsift.session import maybe_broadcast

# fixed values: text columns never imputed with the mode
MODE_EXCLUDE = ("label", "detailed_label", "source_file")


# D1
def sparse_columns(df: DataFrame, threshold: float = 0.20) -> list[str]:
    rows = column_profile(df).select("column", "rows", "missing").collect()  # one row per column
    return [r["column"] for r in rows if r["rows"] and r["missing"] / r["rows"] > threshold]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.20) -> DataFrame:
    """Drop columns whose missing share is strictly above ``threshold``."""
    return df.drop(*sparse_columns(df, threshold))


# D2
def mostly_zero_columns(df: DataFrame, threshold: float = 0.95) -> list[str]:
    rows = column_profile(df).filter(F.col("zeros").isNotNull()).select("column", "rows", "zeros").collect()
    return [r["column"] for r in rows if r["rows"] and r["zeros"] / r["rows"] > threshold]


def drop_constant_zero(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    return df.drop(*mostly_zero_columns(df, threshold))


def _apply_one_row(df: DataFrame, stats: DataFrame, exprs: dict) -> DataFrame:
    keep = [c for c in df.columns if c not in exprs]
    return (df.crossJoin(F.broadcast(stats))
            .select(*[F.col(f"`{c}`") for c in keep], *[e.alias(c) for c, e in exprs.items()])
            .select(*[F.col(f"`{c}`") for c in df.columns]))


# D3
def impute_median(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Numeric NULL -> exact column median (pandas ``median``)."""
    cols = present(df, cols) if cols is not None else numeric_columns(df)
    if not cols:
        return df
    med = quantile_row(df, cols, [0.5])
    return df.withColumns({c: _filled(df, c, med.get((c, 0.5))) for c in cols})


def _filled(df: DataFrame, c: str, value):
    """``c`` with NULL, and NaN of floating columns, replaced."""
    return F.when(_missing(df, c), F.lit(value).cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`"))


# D4
def impute_mode(df: DataFrame, cols: Sequence[str] | None = None,
                exclude: Sequence[str] = MODE_EXCLUDE) -> DataFrame:
    """Text NULL -> most frequent value (smallest value on ties)."""
    cols = present(df, cols) if cols is not None else string_columns(df, exclude)
    if not cols:
        return df
    m = modes(df, cols)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m.get(c)).cast(df.schema[c].dataType)) for c in cols})


def fit_cleaning(df: DataFrame, sparse: float | None = 0.20, zeros: float | None = 0.95,
                 mode_exclude: Sequence[str] = MODE_EXCLUDE) -> dict:
    """D1 + D2 + D3 + D4 fitted in a few small actions.

    One pass (missing and zero counts of every column, a cardinality sketch
    of the numeric ones) decides which columns to drop and how to take
    medians; then exact medians (numeric) and modes (text, two-stage counts)
    of the surviving columns that have NULLs. The result is
    a plain dict (``drop``, ``fill``), so applying it is a single projection
    over one scan, and the same fit applies to any later frame.
    """
    # one pass: missing and zero counts of every column, cardinality sketch of the numeric ones
    num_cols = numeric_columns(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(_missing(df, c)).alias(f"m{i}"))
    for i, c in enumerate(num_cols):
        aggs += [F.count_if(F.col(f"`{c}`") == 0).alias(f"z{i}"), F.approx_count_distinct(F.col(f"`{c}`")).alias(f"h{i}")]
    row = df.agg(*aggs).first()
    n = row["rows"]
    missing = {c: row[f"m{i}"] for i, c in enumerate(df.columns)}
    zero_cnt = {c: row[f"z{i}"] for i, c in enumerate(num_cols)}
    hll = {c: row[f"h{i}"] for i, c in enumerate(num_cols)}
    drop = []
    for c in df.columns:
        if not n:
            continue
        if sparse is not None and missing[c] / n > sparse:
            drop.append(c)
        elif zeros is not None and c in zero_cnt and zero_cnt[c] / n > zeros:
            drop.append(c)
    need = {c for c in df.columns if missing[c] and c not in drop}
    nums = [c for c in num_cols if c in need]
    texts = [c for c in string_columns(df, mode_exclude) if c in need]
    fill = {}
    if nums:
        limit = int(df.sparkSession.conf.get("flowsift.quantiles.mapLimit", str(MAP_LIMIT)))
        small = all((hll[c] or 0) <= limit for c in nums)
        med = quantile_row(df, nums, [0.5], method="map" if small else "select")
        fill.update({c: med[(c, 0.5)] for c in nums if med.get((c, 0.5)) is not None})
    if texts:
        fill.update({c: v for c, v in modes(df, texts).items() if v is not None})
    return {"drop": drop, "fill": fill}


def modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent value per column, the smallest on ties, NULL not counted.

    Two aggregations over a long (column, value) table: counts per value with
    map-side partial counts, then ``min_by`` per column, which is itself a
    partial aggregate; no column's values are ever gathered in one task."""
    cols = list(cols)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string")
                                                 .alias("value")) for c in cols]))).filter(F.col("value").isNotNull())
    cnt = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = cnt.groupBy("column").agg(F.min_by("value", F.struct((-F.col("n")).alias("k"), F.col("value"))).alias("mode"))
    return {r["column"]: r["mode"] for r in best.collect()}  # one row per column


def apply_cleaning(df: DataFrame, fitted: dict) -> DataFrame:
    df = df.drop(*present(df, fitted["drop"]))
    fills = {c: _filled(df, c, v) for c, v in fitted["fill"].items() if c in df.columns}
    return df.withColumns(fills) if fills else df


# D5
def fill_constant(df: DataFrame, value, cols: Sequence[str] | None = None) -> DataFrame:
    cols = present(df, cols) if cols is not None else None
    if isinstance(value, (int, float)):
        floats = [c for c in (cols or df.columns)
                  if df.schema[c].dataType.typeName() in ("double", "float")]
        df = df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in floats})
    return df.fillna(value, subset=cols)


# D6
def impute_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))
                           for c in present(df, cols)})


# D7
def impute_group_median(df: DataFrame, col: str, keys: Sequence[str],
                        max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """NULL -> median within the key group; the global median where the whole
    group is NULL. The group table (one row per key combination) is
    broadcast only after its size is checked; partial aggregation keeps a hot
    key from landing in one task."""
    keys = list(keys)
    grp = exact_quantiles(df, [col], [0.5], keys=keys).select(*keys, F.col("value").alias("_gmed"))
    glob = quantile_row(df, [col], [0.5]).get((col, 0.5))
    out = (df.join(maybe_broadcast(grp, max_broadcast_rows), keys, "left")
           .withColumn(col, F.coalesce(F.col(col), F.col("_gmed"), F.lit(glob).cast(df.schema[col].dataType))))
    return out.select(*df.columns)


def _quartiles(df: DataFrame, cols: Sequence[str], bounds: dict | None = None) -> DataFrame:
    """One row: ``_q<i>`` = [Q1, Q3] of each column (exact, distributed)."""
    b = bounds if bounds is not None else quartiles(df, cols)
    row = [list(b[c]) for c in cols]
    schema = ", ".join(f"_q{i} array<double>" for i in range(len(cols)))
    return df.sparkSession.createDataFrame([tuple(row)], schema)


def quartiles(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """{column: (Q1, Q3)}, exact; fit once, pass to ``iqr_flag`` / ``iqr_cap``."""
    q = quantile_row(df, list(cols), [0.25, 0.75])
    return {c: (q.get((c, 0.25)), q.get((c, 0.75))) for c in cols}


# D8
def iqr_flag(df: DataFrame, cols: Sequence[str], k: float = 1.5, suffix: str = "_outlier",
             bounds: dict | None = None) -> DataFrame:
    """1 where x < Q1 - k*IQR or x > Q3 + k*IQR (exact quartiles)."""
    cols = present(df, cols)
    q = _quartiles(df, cols, bounds)
    exprs = {}
    for i, c in enumerate(cols):
        q1, q3 = F.col(f"_q{i}")[0], F.col(f"_q{i}")[1]
        iqr = q3 - q1
        exprs[f"{c}{suffix}"] = ((F.col(c) < q1 - k * iqr) | (F.col(c) > q3 + k * iqr)).cast("int")
    return (df.crossJoin(F.broadcast(q)).withColumns(exprs)
            .drop(*[f"_q{i}" for i in range(len(cols))]))


def iqr_cap(df: DataFrame, cols: Sequence[str], k: float = 1.5, bounds: dict | None = None) -> DataFrame:
    """Cap at Q3 + k*IQR (upper side only)."""
    cols = present(df, cols)
    q = _quartiles(df, cols, bounds)
    exprs = {}
    for i, c in enumerate(cols):
        q1, q3 = F.col(f"_q{i}")[0], F.col(f"_q{i}")[1]
        exprs[c] = F.least(F.col(c).cast("double"), q3 + k * (q3 - q1))
    return _apply_one_row(df, q, exprs)


# D9
def zscore_flag(df: DataFrame, cols: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Adds ``<c>_z`` = (x - mean) / population std and ``<c>_zflag`` = |z| > limit."""
    cols = present(df, cols)
    st = df.agg(*[F.avg(c).alias(f"_mu{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(c).alias(f"_sd{i}") for i, c in enumerate(cols)])
    z = {f"{c}_z": F.try_divide(F.col(c) - F.col(f"_mu{i}"), F.col(f"_sd{i}")) for i, c in enumerate(cols)}
    tmp = df.crossJoin(F.broadcast(st)).withColumns(z)
    tmp = tmp.withColumns({f"{c}_zflag": F.coalesce((F.abs(F.col(f"{c}_z")) > limit).cast("int"), F.lit(0))
                           for c in cols})
    return tmp.drop(*[f"_mu{i}" for i in range(len(cols))], *[f"_sd{i}" for i in range(len(cols))])
