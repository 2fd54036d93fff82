"""Aggregation, pivots and statistics.

Pivots get explicit value lists where the caller knows them (saves the
distinct job). Totals for normalising come from the aggregated table, never
from a second scan of the data. Correlations are one aggregate over all
column pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.functions.columns import present

MAX_GENERATED = 32  # columns up to which correlations are generated code


def pivot_values(df: DataFrame, col: str, max_values: int = 1000) -> list:
    """Distinct non-null values of ``col`` in order (for pivots); bounded."""
    vals = (df.select(col).filter(F.col(col).isNotNull()).distinct()
            .orderBy(col).limit(max_values + 1).collect())
    if len(vals) > max_values:
        raise ValueError(f"{col} has more than {max_values} values; not a pivot column")
    return [r[0] for r in vals]


def _names(values) -> list[str]:
    return [str(v) for v in values]


# E1 / E2
def crosstab_counts(df: DataFrame, row: str, col: str, values: Sequence | None = None) -> DataFrame:
    """Counts of (row, col); NULL keys dropped (pandas ``crosstab``); absent cells 0."""
    values = list(values) if values is not None else pivot_values(df, col)
    # conditional counts: one shuffle with map-side partial counts (a pivot plans two aggregations)
    return (df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
            .groupBy(row).agg(*[F.count_if(F.col(col) == F.lit(v)).alias(n) for v, n in zip(values, _names(values))]))


def crosstab_pct(df: DataFrame, row: str, col: str, values: Sequence | None = None,
                 normalize: str = "index") -> DataFrame:
    """Cross-tab ×100, normalised by row ('index'), column ('columns') or grand total ('all')."""
    values = list(values) if values is not None else pivot_values(df, col)
    names = _names(values)
    wide = crosstab_counts(df, row, col, values)
    cells = [F.col(f"`{n}`") for n in names]
    if normalize == "index":
        tot = sum(cells[1:], cells[0])
        return wide.select(row, *[(c * 100.0 / tot).alias(n) for c, n in zip(cells, names)])
    if normalize == "columns":
        totals = wide.agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(cells)])  # one row
        j = wide.crossJoin(F.broadcast(totals))
        return j.select(row, *[(c * 100.0 / F.col(f"_t{i}")).alias(n)
                               for i, (c, n) in enumerate(zip(cells, names))])
    if normalize == "all":
        totals = wide.agg(sum((F.sum(c) for c in cells[1:]), F.sum(cells[0])).alias("_t"))
        j = wide.crossJoin(F.broadcast(totals))
        return j.select(row, *[(c * 100.0 / F.col("_t")).alias(n) for c, n in zip(cells, names)])
    raise ValueError(normalize)


# E3
def with_cumulative(wide: DataFrame, cols: Sequence[str], prefix: str = "cum_") -> DataFrame:
    """Running sum along each row of a cross-tab (left to right)."""
    out, acc = {}, None
    for c in cols:
        acc = F.col(f"`{c}`") if acc is None else acc + F.col(f"`{c}`")
        out[f"{prefix}{c}"] = acc
    return wide.withColumns(out)


# E4
def hourly_volume(df: DataFrame, ts: str = "event_time", label: str = "label",
                  values: Sequence | None = None) -> DataFrame:
    """Connections per hour of day × label; absent cells stay NULL (pandas unstack)."""
    values = list(values) if values is not None else pivot_values(df, label)
    return (df.filter(F.col(label).isNotNull()).groupBy(F.hour(ts).alias("hour"))
            .agg(*[F.nullif(F.count_if(F.col(label) == F.lit(v)), F.lit(0)).alias(n)
                   for v, n in zip(values, _names(values))]))


# E5
def volume_series(df: DataFrame, ts: str = "event_time", label: str = "label",
                  every: str = "10 minutes", values: Sequence | None = None) -> DataFrame:
    """Connections per time bin × label; absent cells 0; empty bins absent."""
    values = list(values) if values is not None else pivot_values(df, label)
    return (df.filter(F.col(label).isNotNull())
            .groupBy(F.window(ts, every).start.alias("time_bin"))
            .agg(*[F.count_if(F.col(label) == F.lit(v)).alias(n) for v, n in zip(values, _names(values))]))


def _centered_corr(df: DataFrame, cols: Sequence[str], means: dict) -> DataFrame:
    """Null-free columns: one pass of plain sums of centred products (stable,
    cheap to generate code for), r = S_ab / sqrt(S_aa · S_bb)."""
    z = {c: F.col(f"`{c}`").cast("double") - F.lit(float(means[c])) for c in cols}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    sums = df.agg(*[F.sum(z[a] * z[b]).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    idx = {p: k for k, p in enumerate(pairs)}
    structs = []
    for k, (a, b) in enumerate(pairs):
        den = F.sqrt(F.col(f"p{idx[(a, a)]}") * F.col(f"p{idx[(b, b)]}"))
        r = F.try_divide(F.col(f"p{k}"), F.when(den > 0, den))
        structs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")))
        if a != b:
            structs.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), r.alias("r")))
    return sums.select(F.inline(F.array(*structs)))


def _gram(df: DataFrame, cols: Sequence[str], shift: Sequence[float]) -> DataFrame:
    """(kind, a, sums): for each column ``a`` the sums over rows, against every column b, of
    0: both present, 1: a where b is present, 2: a squared where b is present, 3: a times b.

    Each task adds up matrix products of its batches (NULL and NaN masked) and sends
    4 rows a column; these are added by column. The work is one scan whatever the
    number of columns, and no expression grows with the number of pairs."""
    d, at = len(cols), np.array([float(x) for x in shift])

    def part(batches):
        total = np.zeros((4, d, d))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns]) - at
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(np.float64)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        kind, a = np.divmod(np.arange(4 * d, dtype=np.int32), d)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(list(total.reshape(4 * d, d)))],
                                         names=["kind", "a", "sums"])

    def add(key, table):
        sums = table.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, d).sum(axis=0)
        return pa.table({"kind": pa.array([key[0].as_py()], pa.int32()), "a": pa.array([key[1].as_py()], pa.int32()),
                         "sums": pa.array([sums])})

    schema = "kind int, a int, sums array<double>"
    parts = df.select(*[F.col(f"`{c}`").cast("double") for c in cols]).mapInArrow(part, schema)
    return parts.groupBy("kind", "a").applyInArrow(add, schema)


def _pairwise(df: DataFrame, cols: Sequence[str], shift: Sequence[float]) -> np.ndarray:
    """Pearson r of every two columns over the rows that have both (NaN: undefined)."""
    sums = np.zeros((4, len(cols), len(cols)))
    for r in _gram(df, cols, shift).collect():  # 4 rows a column
        sums[r.kind, r.a] = r.sums
    n, x, xx, xy = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = xy - x * x.T / n
        var = xx - x * x / n  # of a, where b is present
        # differences that are rounding alone are constant columns
        var = np.where(var <= 1e-13 * xx, 0.0, var)
        r = cov / np.sqrt(var * var.T)
    return np.where(np.isfinite(r), np.clip(r, -1.0, 1.0), np.nan)


# E6
def correlation_matrix(df: DataFrame, cols: Sequence[str], target: str | None = None,
                       top: int = 15) -> DataFrame:
    """Long form (a, b, r), Pearson with pairwise-complete rows (pandas
    ``corr``); NULL for a constant column. With more than ``top`` columns
    and a target, keeps the ``top`` columns with the largest |r(target)|
    (ties by name).

    One small pass counts missing values and takes means. Few columns without
    any are one pass of centred product sums in generated code; otherwise masked
    Gram matrices give all pairs in one pass."""
    cols = present(df, cols)
    allc = cols + ([target] if target and target not in cols else [])
    real = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in allc]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(x).alias(f"c{i}") for i, x in enumerate(real)],
                 *[F.avg(x).alias(f"m{i}") for i, x in enumerate(real)]).first()
    means = {c: one[f"m{i}"] or 0.0 for i, c in enumerate(allc)}
    plain = len(allc) <= MAX_GENERATED and all(one[f"c{i}"] == one["_n"] for i in range(len(allc)))
    matrix = None if plain else _pairwise(df, allc, [means[c] for c in allc])
    if target is not None and len(cols) > top:
        if plain:
            tr = {r["a"]: r["r"] for r in _centered_corr(df, allc, means).filter(F.col("b") == target).collect()}
        else:
            tr = dict(zip(allc, matrix[:, allc.index(target)].tolist()))
        ranked = sorted(cols, key=lambda c: (-(abs(tr[c]) if tr.get(c) is not None and not math.isnan(tr[c])
                                               else -1.0), c))
        cols = ranked[:top]
    if plain:
        return _centered_corr(df, cols, means)
    at = [allc.index(c) for c in cols]
    rows = [(a, b, None if math.isnan(r) else r) for i, a in zip(at, cols) for j, b in zip(at, cols)
            for r in [float(matrix[i, j])]]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


# E7
def class_centroids(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(label).agg(*[F.avg(c).alias(c) for c in cols])


# E9
def histogram(df: DataFrame, col: str, bins: int = 10, by: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max] (the last bin holds max), like numpy."""
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(
        F.least(F.floor((x - F.col("_lo")) / w), F.lit(bins - 1))).cast("int")
    keys = ([by] if by else []) + ["bin"]
    g = (df.filter(x.isNotNull()).crossJoin(F.broadcast(rng)).withColumn("bin", b)
         .groupBy(*keys, "_lo", "_hi").agg(F.count(F.lit(1)).alias("count")))
    return g.select(*keys, (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("hi"),
                    "count")


# E8
def kde(df: DataFrame, col: str, by: str | None = None, grid: int = 200, log10: bool = True,
        zero_as: float = 0.1, fine_bins: int = 4096, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density of (log10) ``col`` per class on ``grid`` points.

    Scott bandwidth h = std · n^(-1/5) per class. The data are first reduced
    to ``fine_bins`` weighted bin centres per class (linear binning), then each
    centre is spread over the grid with ``sequence``/``explode``: the work is
    classes × bins × grid, independent of the row count; no per-row UDF."""
    x = F.col(col).cast("double")
    x = F.when(x == 0, F.lit(zero_as)).otherwise(x)
    v = F.log10(x) if log10 else x
    keys = [by] if by else []
    base = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    st = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("_v").alias("sd"),
                                 F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), -0.2))
    st = st.withColumn("glo", F.col("lo") - cut * F.col("h")).withColumn("ghi", F.col("hi") + cut * F.col("h"))
    # one row per class: bounded by the number of classes
    fw = F.greatest((F.col("hi") - F.col("lo")) / fine_bins, F.lit(1e-12))
    binned = (base.join(F.broadcast(st), keys) if keys else base.crossJoin(F.broadcast(st)))
    binned = (binned.withColumn("_b", F.least(F.floor((F.col("_v") - F.col("lo")) / fw), F.lit(fine_bins - 1)))
              .groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("w"), F.avg("_v").alias("c")))
    pts = (binned.join(F.broadcast(st), keys) if keys else binned.crossJoin(F.broadcast(st)))
    pts = pts.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    gx = F.col("glo") + F.col("g") * (F.col("ghi") - F.col("glo")) / (grid - 1)
    z = (gx - F.col("c")) / F.col("h")
    dens = F.col("w") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return (pts.select(*keys, "g", gx.alias("x"), dens.alias("d"))
            .groupBy(*keys, "g", "x").agg(F.sum("d").alias("density")).drop("g"))


# H1 / H2 / H3 / H5
def top_n(df: DataFrame, order_col: str, n: int, ascending: bool = False, by_abs: bool = False,
          tie: str | None = None) -> DataFrame:
    """First ``n`` rows by a column (TakeOrderedAndProject: a per-task top-n, no full sort)."""
    key = F.abs(F.col(order_col)) if by_abs else F.col(order_col)
    key = key.asc_nulls_last() if ascending else key.desc_nulls_last()
    order = [key] + ([F.asc(tie)] if tie else [])
    return df.orderBy(*order).limit(n)
