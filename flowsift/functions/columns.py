"""Row-wise projections and filters.

Every function is ``df -> df`` built from JVM-side expressions, so Catalyst
keeps them inside whole-stage codegen and prunes/pushes around them. Column
arguments are names; operators skip columns that are absent, as the
reference does.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)

# fixed values: columns the reference coerces from log text to numbers
LOG_NUMERIC_COLUMNS = ("duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts",
                       "orig_ip_bytes", "resp_ip_bytes")
# fixed values: columns removed before modelling
DROP_BEFORE_MODEL = ("uid", "orig_h", "resp_h", "ts", "tunnel_parents", "timestamp")


def present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in cols if c in have]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in ex]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in ex]


def _nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


# B1
def coerce_numeric(df: DataFrame, cols: Sequence[str] = LOG_NUMERIC_COLUMNS,
                   rename: dict[str, str] | None = None) -> DataFrame:
    """Text or number -> double; unparsable text ('-', '') -> NULL, NaN -> NULL."""
    rename = rename or {}
    out = {}
    for c in present(df, cols):
        out[rename.get(c, c)] = _nan_to_null(F.col(c).cast("string").try_cast("double"))
    df = df.withColumns(out)
    return df.drop(*[c for c in rename if c in df.columns and c not in rename.values()])


# B2
def with_event_time(df: DataFrame, ts: str = "ts", out: str = "event_time") -> DataFrame:
    """Epoch seconds (fractional) -> TIMESTAMP, microseconds kept."""
    if ts not in df.columns:
        return df
    return df.withColumn(out, F.timestamp_seconds(F.col(ts)))


# B3
def time_features(df: DataFrame, ts: str = "event_time") -> DataFrame:
    """hour 0-23, day_of_week with Monday=0, is_weekend for Saturday/Sunday."""
    if ts not in df.columns:
        return df
    dow = F.weekday(F.col(ts))
    return df.withColumns({
        "hour": F.hour(F.col(ts)),
        "day_of_week": dow,
        "is_weekend": dow.isin(5, 6).cast("int"),
    })


# B4
def time_bin(df: DataFrame, ts: str = "event_time", every: str = "10 minutes",
             out: str = "time_bin") -> DataFrame:
    """Floor the event time to a fixed bin (tumbling window start)."""
    return df.withColumn(out, F.window(F.col(ts), every).start)


# B5
def volume_features(df: DataFrame) -> DataFrame:
    """total_bytes / total_pkts; NULL when either side is NULL."""
    out = {}
    if {"orig_bytes", "resp_bytes"} <= set(df.columns):
        out["total_bytes"] = F.col("orig_bytes") + F.col("resp_bytes")
    if {"orig_pkts", "resp_pkts"} <= set(df.columns):
        out["total_pkts"] = F.col("orig_pkts") + F.col("resp_pkts")
    return df.withColumns(out) if out else df


# B6
def log1p_features(df: DataFrame, cols: Sequence[str] = ("total_bytes", "total_pkts"),
                   prefix: str = "log_") -> DataFrame:
    out = {f"{prefix}{c}": F.log1p(F.col(c)) for c in present(df, cols)}
    return df.withColumns(out) if out else df


# B7
def bytes_per_packet(df: DataFrame, eps_mode: str = "replace_zero") -> DataFrame:
    """bytes / packets. ``replace_zero``: 0 packets count as 1 (code);
    ``plus_one``: bytes / (packets + 1) (thesis)."""
    out = {}
    for side in ("orig", "resp"):
        b, p = f"{side}_bytes", f"{side}_pkts"
        if {b, p} <= set(df.columns):
            den = (F.when(F.col(p) == 0, F.lit(1)).otherwise(F.col(p)) if eps_mode == "replace_zero"
                   else F.col(p) + 1)
            out[f"{side}_bytes_per_pkt"] = F.col(b) / den
    return df.withColumns(out) if out else df


# B8
def ratio_features(df: DataFrame) -> DataFrame:
    out = {}
    if {"orig_bytes", "resp_bytes"} <= set(df.columns):
        out["bytes_ratio"] = F.col("orig_bytes") / (F.col("resp_bytes") + 1)
    if {"orig_pkts", "resp_pkts"} <= set(df.columns):
        out["pkts_ratio"] = F.col("orig_pkts") / (F.col("resp_pkts") + 1)
    return df.withColumns(out) if out else df


# B10
def split_compound_label(df: DataFrame, src: str = "label", label: str = "label",
                         detail: str = "detailed_label") -> DataFrame:
    """'Malicious   C&C' -> label 'Malicious', detail 'C&C' (split at 2+ blanks,
    after trimming). The detail is filled only where it is NULL or ''."""
    parts = F.split(F.trim(F.col(src)), r"\s{2,}")
    head = F.try_element_at(parts, F.lit(1))
    tail = F.try_element_at(parts, F.lit(2))
    cur = F.col(detail) if detail in df.columns else F.lit(None).cast("string")
    filled = F.when(cur.isNull() | (cur == ""), tail).otherwise(cur)
    return df.withColumns({label: head, detail: filled})


# B9
def standardise_label(df: DataFrame, col: str = "label") -> DataFrame:
    """Trim; anything containing 'Malicious' becomes 'Malicious'."""
    c = F.trim(F.col(col))
    return df.withColumn(col, F.when(c.contains("Malicious"), F.lit("Malicious")).otherwise(c))


# B11
def fill_detailed_label(df: DataFrame, label: str = "label",
                        detail: str = "detailed_label") -> DataFrame:
    if detail not in df.columns:
        return df
    d, lab = F.col(detail), F.col(label)
    return df.withColumn(detail, F.when(d.isNull() & (lab == "Malicious"), F.lit("unknown"))
                         .when(d.isNull() & (lab == "Benign"), F.lit("")).otherwise(d))


def clean_labels(df: DataFrame, src: str = "label", label: str = "label",
                 detail: str = "detailed_label") -> DataFrame:
    """The corrected order: split, standardise, then fill."""
    return fill_detailed_label(standardise_label(split_compound_label(df, src, label, detail), label),
                               label, detail)


# B12 / B17
def keep_classes(df: DataFrame, col: str = "label",
                 values: Sequence[str] = ("Benign", "Malicious")) -> DataFrame:
    return df.filter(F.col(col).isin(*values))


# B13
def binary_target(df: DataFrame, col: str = "label", out: str = "target",
                  positive: str = "Malicious", negative: str = "Benign") -> DataFrame:
    c = F.col(col)
    return df.withColumn(out, F.when(c == positive, 1).when(c == negative, 0)
                         .otherwise(F.lit(None)).cast("int"))


# B14
def drop_if_present(df: DataFrame, cols: Sequence[str] = DROP_BEFORE_MODEL) -> DataFrame:
    return df.drop(*present(df, cols))


# B15
def numeric_only(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    cols = [c for c in df.columns if c in set(numeric_columns(df)) or c in set(keep)]
    return df.select(*[F.col(f"`{c}`") for c in cols])


# B16
def replace_value(df: DataFrame, col: str, old=0, new=0.1) -> DataFrame:
    c = F.col(col)
    return df.withColumn(col, F.when(c == old, F.lit(new)).otherwise(c))


# B18
def missing_flags(df: DataFrame, cols: Sequence[str], suffix: str = "_missing") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": F.col(c).isNull().cast("int") for c in present(df, cols)})


# B19
def backscatter_flag(df: DataFrame, states: Sequence[str], protos: Sequence[str],
                     out: str = "is_backscatter") -> DataFrame:
    return df.withColumn(out, (F.col("conn_state").isin(*states) & F.col("proto").isin(*protos))
                         .cast("int"))


# B20
def scanning_flag(df: DataFrame, min_conns: int, max_bytes: float, rate_col: str = "conn_rate",
                  bytes_col: str = "total_bytes", out: str = "is_scanning_behavior") -> DataFrame:
    """Many connections in the window (G1 output) carrying few bytes."""
    return df.withColumn(out, ((F.col(rate_col) >= min_conns)
                               & (F.coalesce(F.col(bytes_col), F.lit(0)) <= max_bytes)).cast("int"))


# B21
def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


# B22
def predict_label(df: DataFrame, prob: str = "score", threshold: float = 0.5,
                  out: str = "prediction") -> DataFrame:
    return df.withColumn(out, (F.col(prob) > threshold).cast("int"))
