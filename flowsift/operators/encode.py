"""Encoding and scaling.

Fitted state is small and explicit: category lists (bounded by a
cardinality check), per-category statistics (joined after a size check) and
one row of means / deviations. Fit on the training split, apply to any frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.functions.columns import present
from flowsift.operators.profile import cardinality
from flowsift.session import maybe_broadcast

MAX_CATEGORIES = 10_000
MAX_LABELS = 100_000


# J1
def label_encode(df: DataFrame, cols: Sequence[str], fill: str = "unknown", suffix: str = "",
                 max_labels: int = MAX_LABELS):
    """Codes 0.. in alphabetical order (NULL -> ``fill`` first). Returns (frame, fitted indexer model).

    The fitted model holds every label on the driver, so columns of more than
    about ``max_labels`` distinct values (a HyperLogLog estimate) are an error."""
    cols = present(df, cols)
    if not cols:
        return df, None
    filled = df.fillna(fill, subset=cols)
    many = [r["column"] for r in cardinality(filled, cols, exact=False).collect() if r["n_distinct"] > max_labels]
    if many:
        raise ValueError(f"{', '.join(many)}: more than {max_labels} labels")
    outs = [f"{c}{suffix or '_idx'}" for c in cols]
    model = StringIndexer(inputCols=cols, outputCols=outs, stringOrderType="alphabetAsc",
                          handleInvalid="keep").fit(filled)
    out = model.transform(filled)
    out = out.withColumns({c: F.col(o).cast("int") for c, o in zip(cols, outs)}).drop(*outs)
    return out, model


# J2
def category_codes(df: DataFrame, cols: Sequence[str], max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """Alphabetical category codes; NULL -> -1 (pandas ``cat.codes``).

    The category list is checked against ``max_categories`` before it is
    built, so the (value, code) table broadcast is bounded."""
    cols = present(df, cols)
    spark = df.sparkSession
    out = df
    for c in cols:
        vals = categories(df, c, max_categories)  # raises above the bound: not a categorical column
        cats = spark.createDataFrame([(v, i) for i, v in enumerate(vals)],
                                     f"_v {df.schema[c].dataType.simpleString()}, _{c}_code int")
        out = (out.join(F.broadcast(cats), out[c] == cats["_v"], "left")
               .withColumn(c, F.coalesce(F.col(f"_{c}_code"), F.lit(-1))).drop("_v", f"_{c}_code"))
    return out


def categories(df: DataFrame, col: str, max_categories: int = MAX_CATEGORIES) -> list:
    vals = (df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)
            .limit(max_categories + 1).collect())
    if len(vals) > max_categories:
        raise ValueError(f"{col}: more than {max_categories} categories")
    return [r[0] for r in vals]


# J3
def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = True,
            levels: dict[str, list] | None = None) -> DataFrame:
    """0/1 dummy columns ``<col>_<value>``; the alphabetically first value is
    dropped when ``drop_first``; NULL gives all zeros. The source column is removed."""
    levels = dict(levels or {})
    out = df
    for c in present(df, cols):
        vals = levels.get(c) or categories(df, c)
        keep = vals[1:] if drop_first else vals
        out = out.withColumns({f"{c}_{v}": (F.col(c) == F.lit(v)).cast("int") for v in keep})
        out = out.withColumns({f"{c}_{v}": F.coalesce(F.col(f"{c}_{v}"), F.lit(0)) for v in keep}).drop(c)
    return out


# J4
def encode_auto(df: DataFrame, cols: Sequence[str], lo: int = 10, hi: int = 100):
    """Cardinality router: < lo values -> one-hot, lo..hi-1 -> codes, >= hi left as text.
    Returns (frame, {column: route}).

    One HyperLogLog pass; only columns whose estimate lies near a limit are
    counted exactly, so no column of many values is."""
    cols = present(df, cols)
    card = {r["column"]: r["n_distinct"] for r in cardinality(df, cols, exact=False).collect()}
    near = [c for c in cols if any(abs(card[c] - limit) <= 2 + 0.1 * limit for limit in (lo, hi))]
    if near:
        card |= {r["column"]: r["n_distinct"] for r in cardinality(df, near).collect()}
    route = {c: ("one_hot" if card[c] < lo else "codes" if card[c] < hi else "text") for c in cols}
    out = one_hot(df, [c for c in cols if route[c] == "one_hot"])
    out = category_codes(out, [c for c in cols if route[c] == "codes"])
    return out, route


# J5
def fit_target_encoder(train: DataFrame, col: str, target: str) -> tuple[DataFrame, float]:
    stats = train.groupBy(col).agg(F.avg(F.col(target).cast("double")).alias(f"{col}_te"))
    prior = train.agg(F.avg(F.col(target).cast("double"))).first()[0]
    return stats, prior


def apply_target_encoder(df: DataFrame, col: str, stats: DataFrame, prior: float,
                         max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """category -> mean target on the training rows; unseen or NULL -> training mean."""
    j = df.join(maybe_broadcast(stats, max_broadcast_rows), col, "left")
    return j.withColumn(f"{col}_te", F.coalesce(F.col(f"{col}_te"), F.lit(prior)))


def target_encode(train: DataFrame, df: DataFrame, col: str, target: str) -> DataFrame:
    stats, prior = fit_target_encoder(train, col, target)
    return apply_target_encoder(df, col, stats, prior)


# J6
def collapse_rare(df: DataFrame, col: str, min_share: float = 0.01, other: str = "other") -> DataFrame:
    """Values whose share of rows is below ``min_share`` become ``other``.

    At most 1/min_share values can reach the share, so the kept list is
    bounded by construction and travels as literals."""
    n = df.count()
    cap = int(1 / min_share) + 1
    kept = [r[0] for r in (df.groupBy(col).count().filter(F.col("count") >= F.lit(min_share * n))
                           .filter(F.col(col).isNotNull()).limit(cap).collect())]
    c = F.col(col)
    return df.withColumn(col, F.when(c.isNull(), c).when(c.isin(*kept), c).otherwise(F.lit(other)))


# J7
def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and *population* std per column (σ = 0 -> 1), from one aggregate row."""
    cols = present(df, cols)
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        mu, sd = row[f"m{i}"], row[f"s{i}"]
        out[c] = (mu if mu is not None else 0.0, sd if sd not in (None, 0.0) else 1.0)
    return out


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(mu)) / F.lit(sd) for c, (mu, sd) in scaler.items()
                           if c in df.columns})


# J8
def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector column; ``features`` (the names) is the caller's list, in order."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def feature_columns(df: DataFrame, exclude: Sequence[str] = ("label", "detailed_label", "source_file",
                                                             "target", "label_encoded", "split", "fold",
                                                             "weight")) -> list[str]:
    """Numeric columns that may be features (label columns never: SURVEY §2.16 row 1)."""
    from flowsift.functions.columns import numeric_columns
    return numeric_columns(df, exclude)
