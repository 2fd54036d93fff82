"""Sampling, splitting and balancing.

Randomness is ``md5(seed || ':' || id)``: the same rows on any partitioning
and replayable in SQL. Exact per-class ranks never put a class into one
task: rows are spread over 16^4 md5-prefix buckets, the small table of
(class, bucket) counts is prefix-summed, and each row's rank is its offset
plus its rank inside its (class, bucket).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.session import join_null_safe, maybe_broadcast


def random_key(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def uniform(id_col: str, seed: int = 42) -> Column:
    """Deterministic U[0, 1) from the first 32 bits of the md5 key."""
    return F.conv(F.substring(random_key(id_col, seed), 1, 8), 16, 10).cast("bigint") / float(16 ** 8)


# I1
def sample_n(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows: the n smallest md5 keys.

    A plain ``orderBy(key).limit(n)`` sends up to n rows from every input
    task to one merging task. Instead the rows whose key prefix lies below a
    threshold t are kept first (a narrow filter): t is set so that at least n
    rows pass with overwhelming probability (n + 6·sqrt(n) + 20 expected),
    and since key order agrees with prefix order, the n smallest keys are all
    among them; the final top-n then merges about n rows. If fewer than n
    pass (practically never), the threshold is doubled and the step repeated.
    """
    total = df.count()
    if n >= total:
        return df
    k = random_key(id_col, seed)
    expected = n + 6 * math.sqrt(n) + 20
    t = expected / total
    while True:
        cut = int(min(t, 1.0) * 16 ** 8)
        cand = df.withColumn("_k", k).filter(F.conv(F.substring("_k", 1, 8), 16, 10).cast("bigint") < cut)
        if t >= 1.0 or cand.count() >= n:
            return cand.orderBy("_k").limit(n).drop("_k")
        t *= 2


def class_rank(df: DataFrame, label: str | None, id_col: str, seed: int = 42, hex_digits: int = 4,
               out: str = "_rank", size_out: str = "_n", tasks: int | None = None) -> DataFrame:
    """0-based rank of each row inside its class in md5-key order, and the class size.

    A NULL class is a class of its own. The bucket is the key's first ``hex_digits`` hex digits (16^d buckets), so
    bucket order agrees with key order and offset + local rank is the exact rank.
    tasks: the number of partitions of the result (None: the session's).
    """
    keys = [label] if label else []
    x = (df.withColumn("_k", random_key(id_col, seed))
         .withColumn("_b", F.conv(F.substring("_k", 1, hex_digits), 16, 10).cast("int")))
    counts = x.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*keys).orderBy("_b")
    offsets = (counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                                    F.lit(0)))
               .withColumn(size_out, F.sum("_cnt").over(Window.partitionBy(*keys)))
               .drop("_cnt"))
    # classes × buckets rows; broadcast after a size check
    x = join_null_safe(x, maybe_broadcast(offsets), keys + ["_b"])
    x = x.repartition(tasks, *keys, "_b") if tasks else x
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_k")) - 1
    return x.withColumn(out, F.col("_off") + local).drop("_k", "_b", "_off")


def _assign(rank: Column, n: Column, names: Sequence[str], fracs: Sequence[float]) -> Column:
    cum, acc = [], 0.0
    for f in fracs:
        acc += f
        cum.append(acc)
    expr = F.lit(names[-1])
    for name, c in reversed(list(zip(names[:-1], cum[:-1]))):
        expr = F.when(rank < F.round(n * F.lit(c)), F.lit(name)).otherwise(expr)
    return expr


# I2 / I4
def stratified_split(df: DataFrame, label: str, fracs: Sequence[float] = (0.75, 0.25),
                     names: Sequence[str] = ("train", "test"), id_col: str = "uid", seed: int = 42,
                     hex_digits: int = 4, out: str = "split", tasks: int | None = None) -> DataFrame:
    """Per class: the first round(n·f1) rows by md5 key -> names[0], the next up
    to round(n·(f1+f2)) -> names[1], ... Class shares equal in every split
    to within one row."""
    x = class_rank(df, label, id_col, seed, hex_digits, tasks=tasks)
    return x.withColumn(out, _assign(F.col("_rank"), F.col("_n"), names, fracs)).drop("_rank", "_n")


# I3
def random_split(df: DataFrame, fracs: Sequence[float] = (0.75, 0.25), names: Sequence[str] = ("train", "test"),
                 id_col: str = "uid", seed: int = 42, out: str = "split") -> DataFrame:
    """Independent per-row draw (no shuffle); sizes are right in expectation."""
    u = uniform(id_col, seed)
    expr, acc, bounds = F.lit(names[-1]), 0.0, []
    for f in fracs[:-1]:
        acc += f
        bounds.append(acc)
    for name, b in reversed(list(zip(names[:-1], bounds))):
        expr = F.when(u < F.lit(b), F.lit(name)).otherwise(expr)
    return df.withColumn(out, expr)


# I5
def assign_folds(df: DataFrame, label: str, k: int = 5, id_col: str = "uid", seed: int = 42,
                 hex_digits: int = 4, out: str = "fold") -> DataFrame:
    """Stratified, shuffled k-fold ids: rank inside the class modulo k."""
    x = class_rank(df, label, id_col, seed, hex_digits)
    return x.withColumn(out, (F.col("_rank") % k).cast("int")).drop("_rank", "_n")


# I2 + I5
def split_and_folds(df: DataFrame, label: str, fracs: Sequence[float] = (0.75, 0.25),
                    names: Sequence[str] = ("train", "test"), k: int = 5, id_col: str = "uid", seed: int = 42,
                    tasks: int | None = None) -> DataFrame:
    """``stratified_split`` and ``assign_folds`` of one seed, from one ranking."""
    x = class_rank(df, label, id_col, seed, tasks=tasks)
    return (x.withColumn("split", _assign(F.col("_rank"), F.col("_n"), names, fracs))
            .withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_n"))


# I7
def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """'balanced' weights n / (classes · n_c) as a column."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    counts = counts.withColumn("_w", F.sum("_nc").over(Window.partitionBy()) /
                               (F.count(F.lit(1)).over(Window.partitionBy()) * F.col("_nc")))
    return join_null_safe(df, maybe_broadcast(counts.select(label, F.col("_w").alias(out))), [label], "left")


def class_weight_table(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("weight", F.sum("count").over(Window.partitionBy()) /
                             (F.count(F.lit(1)).over(Window.partitionBy()) * F.col("count")))
