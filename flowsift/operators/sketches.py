"""Profiles of many files from stored, mergeable sketches.

For every file and column a row keeps the counts, the least and greatest value, a
HyperLogLog sketch of the distinct values and, for numbers, a KLL sketch of the
quantiles. The folder's profile merges the rows of all files, so a new file costs
a scan of that file alone. Counts and extremes are exact; distinct counts and
quantiles are as near as the sketches are (relative error of distinct counts about
1 / 2^(lg_k / 2), rank error of quantiles below 2 % at the default size).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.functions.columns import numeric_columns
from flowsift.operators.profile import _missing

LG_K = 12    # 2^12 registers of a HyperLogLog sketch
KLL_K = 400


def file_sketches(df: DataFrame, file_col: str = "source_file", cols: Sequence[str] | None = None) -> DataFrame:
    """A row for each file and column: counts, extremes and sketches. One grouped pass."""
    cols = [c for c in df.columns if c != file_col] if cols is None else list(cols)
    numbers, aggs, rows = set(numeric_columns(df)), [F.count(F.lit(1)).alias("rows")], []
    for i, c in enumerate(cols):
        x = F.when(~_missing(df, c), F.col(f"`{c}`"))
        aggs += [F.count_if(_missing(df, c)).alias(f"m{i}"), F.hll_sketch_agg(x.cast("string"), F.lit(LG_K)).alias(f"h{i}")]
        nothing = F.lit(None)
        if c in numbers:
            v = x.cast("double")
            aggs += [F.kll_sketch_agg_double(v, F.lit(KLL_K)).alias(f"k{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        kll, lo, hi = (F.col(f"{n}{i}") if c in numbers else nothing for n in ("k", "lo", "hi"))
        rows.append(F.struct(F.lit(c).alias("column"), "rows", F.col(f"m{i}").alias("missing"), lo.cast("double").alias("lo"),
                             hi.cast("double").alias("hi"), F.col(f"h{i}").alias("hll"), kll.cast("binary").alias("kll")))
    return df.groupBy(F.col(file_col).alias("file")).agg(*aggs).select("file", F.inline(F.array(*rows)))


def merged_profile(sketches: DataFrame) -> DataFrame:
    """The profile of all files: column, files, rows, missing, n_distinct, min, q25, q50, q75, max."""
    some = F.when(F.col("rows") > F.col("missing"), F.col("kll"))  # a sketch of nothing has no quantiles
    one = sketches.groupBy("column").agg(
        F.count_distinct("file").alias("files"), F.sum("rows").alias("rows"), F.sum("missing").alias("missing"),
        F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("n_distinct"), F.min("lo").alias("min"), F.max("hi").alias("max"),
        F.kll_merge_agg_double(some).alias("kll"))
    q = {f"q{round(100 * p)}": F.when(F.col("min").isNotNull(), F.kll_sketch_get_quantile_double("kll", F.lit(p)))
         for p in (0.25, 0.5, 0.75)}
    return one.withColumns(q).select("column", "files", "rows", "missing", "n_distinct", "min", "q25", "q50", "q75", "max")


def update_store(spark: SparkSession, store: str, files: Sequence[str], read: Callable[[list[str]], DataFrame],
                 file_col: str = "source_file") -> list[str]:
    """Add the sketches of the files that the store doesn't have; returns those files.

    ``read`` makes the rows of some files, with the name that ``files`` uses in ``file_col``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    known: set[str] = set()
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        known = {r.file for r in spark.read.parquet(store).select("file").distinct().collect()}  # a row a file
    new = [f for f in files if f not in known]
    if new:
        file_sketches(read(new), file_col).write.mode("append").parquet(store)
    return new
