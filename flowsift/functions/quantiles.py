"""Exact quantiles (linear interpolation, as pandas / DuckDB ``quantile_cont``)
without a per-column value map in one task.

Spark's ``percentile`` / ``median`` keep a value -> count map per column
(or group) and merge it in one task: fine for ports and counters, unbounded
for high-cardinality doubles. ``exact_quantiles`` checks the cardinality
first (HyperLogLog, fused into the pass that also computes approximate
split points) and, above ``map_limit`` distinct values, selects by rank:

1. approximate quantiles give ``buckets`` value ranges per column;
2. distinct (group, column, value) rows are counted (map-side partial counts);
3. per (group, column, bucket) totals are prefix-summed in a small table,
   which tells in which bucket each target rank lies;
4. only those buckets are ordered by value, each in its own task, and the
   values at ranks floor(p·(n-1)) and the next one are interpolated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.session import cut_lineage, join_null_safe, maybe_broadcast

MAP_LIMIT = 2_000_000


def _value(df: DataFrame, c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (),
                    buckets: int = 256, accuracy: int = 10_000, map_limit: int | None = None,
                    method: str = "auto") -> DataFrame:
    """Long result (keys..., column, p, value); NULL / NaN values are ignored,
    a group without values gives NULL. ``method``: 'auto', 'map' or 'select'.
    ``map_limit`` defaults to the session setting ``flowsift.quantiles.mapLimit``."""
    cols, keys, probs = list(cols), list(keys), [float(p) for p in probs]
    if map_limit is None:
        map_limit = int(df.sparkSession.conf.get("flowsift.quantiles.mapLimit", str(MAP_LIMIT)))
    if method == "auto":
        d = df.agg(*[F.approx_count_distinct(F.struct(*[F.col(k) for k in keys], _value(df, c)) if keys
                                             else _value(df, c)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
        method = "map" if all((d[f"d{i}"] or 0) <= map_limit for i in range(len(cols))) else "select"
    if method == "map":
        return _map_quantiles(df, cols, probs, keys)
    pr = [i / buckets for i in range(1, buckets)]
    s = df.agg(*[F.percentile_approx(_value(df, c), pr, accuracy).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return _select_quantiles(df, cols, probs, keys, [s[f"s{i}"] or [] for i in range(len(cols))])


def _map_quantiles(df: DataFrame, cols, probs, keys) -> DataFrame:
    arr = F.array(*[F.lit(p) for p in probs])
    g = df.groupBy(*keys) if keys else df
    one = g.agg(*[F.percentile(_value(df, c), arr).alias(f"q{i}") for i, c in enumerate(cols)])
    return one.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(p).alias("p"), F.col(f"q{i}")[j].cast("double").alias("value"))
        for i, c in enumerate(cols) for j, p in enumerate(probs)])))


def _select_quantiles(df: DataFrame, cols, probs, keys, split_lists) -> DataFrame:
    splits = [[float("-inf")] + sorted({float(s) for s in sl if s is not None}) + [float("inf")]
              for sl in split_lists]
    x = df.select(*keys, *[_value(df, c).alias(f"_c{i}") for i, c in enumerate(cols)])
    x = Bucketizer(inputCols=[f"_c{i}" for i in range(len(cols))], outputCols=[f"_b{i}" for i in range(len(cols))],
                   splitsArray=splits, handleInvalid="keep").transform(
        x.fillna(float("nan"), subset=[f"_c{i}" for i in range(len(cols))]))
    long = x.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("v"), F.col(f"_b{i}").cast("int").alias("b"))
        for i, c in enumerate(cols)]))).filter(~F.isnan("v"))
    gk = keys + ["column"]
    # distinct values with counts: reused by the totals and the final ordering
    cnt = cut_lineage(long.groupBy(*gk, "b", "v").agg(F.count(F.lit(1)).alias("c")))
    tot = cnt.groupBy(*gk, "b").agg(F.sum("c").alias("bt"))
    tot = (tot.withColumn("before", F.coalesce(F.sum("bt").over(
        Window.partitionBy(*gk).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("n", F.sum("bt").over(Window.partitionBy(*gk))))
    targets = (tot.select(*gk, "b", "before", "bt", "n").withColumn("p", F.explode(F.array(*[F.lit(p) for p in probs])))
               .withColumn("pos", F.col("p") * (F.col("n") - 1))
               .withColumn("r0", F.floor("pos")).withColumn("r1", F.least(F.col("r0") + 1, F.col("n") - 1))
               .withColumn("frac", F.col("pos") - F.col("r0")))
    need = targets.select(*gk, "b", "before", "p", "frac", F.inline(F.array(
        F.struct(F.lit(0).alias("which"), F.col("r0").alias("r")),
        F.struct(F.lit(1).alias("which"), F.col("r1").alias("r"))))) \
        .filter((F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("bt")))
    need = maybe_broadcast(need)  # groups × columns × probs × 2 rows
    hit = maybe_broadcast(need.select(*gk, "b", "before").distinct())
    within = join_null_safe(cnt, hit, gk + ["b"])
    w = Window.partitionBy(*gk, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    within = within.withColumn("cb", F.col("before") + F.coalesce(F.sum("c").over(w), F.lit(0)))
    picked = (join_null_safe(within, need, gk + ["b", "before"])
              .filter((F.col("r") >= F.col("cb")) & (F.col("r") < F.col("cb") + F.col("c")))
              .groupBy(*gk, "p").agg(F.max("frac").alias("frac"),
                                     F.max(F.when(F.col("which") == 0, F.col("v"))).alias("v0"),
                                     F.max(F.when(F.col("which") == 1, F.col("v"))).alias("v1")))
    out = picked.select(*gk, "p", (F.col("v0") + F.col("frac") * (F.col("v1") - F.col("v0"))).alias("value"))
    # groups (and columns) without values: NULL
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    every = groups.select(*keys, F.explode(F.array(*map(F.lit, cols))).alias("column")).withColumn(
        "p", F.explode(F.array(*[F.lit(p) for p in probs])))
    return join_null_safe(every, out, gk + ["p"], "left").select(*gk, "p", "value")


def quantile_row(df: DataFrame, cols: Sequence[str], probs: Sequence[float], **kw) -> dict:
    """{(column, p): value} for a whole table (a handful of numbers on the driver)."""
    return {(r["column"], r["p"]): r["value"] for r in exact_quantiles(df, cols, probs, **kw).collect()}
