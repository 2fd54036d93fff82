"""Checkable queries for projections, profiling, cleaning and statistics
(SURVEY §2.2–2.5, 2.8) over the ``flows`` view of ``events``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.functions import columns as C
from flowsift.operators import clean as D
from flowsift.operators import profile as P
from flowsift.operators import stats as S
from flowsift.plans import oracle_views as V
from flowsift.plans.preprocess import clean_flows, raw_log_from_view
from flowsift.plans.registry import query
from flowsift.sources import logs
from flowsift.sources.views import flows, flows_from_lineitem, read_table

LABELS = ["Benign", "Malicious"]


def raw(spark: SparkSession, d: str) -> DataFrame:
    return C.coerce_numeric(raw_log_from_view(flows(spark, d)))


def labeled(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_labels(raw(spark, d))


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return clean_flows(raw_log_from_view(flows(spark, d)))


# ---------------------------------------------------------------- B: columns

@query("raw_flows", f"WITH {V.RAW} SELECT * FROM raw",
       doubles=("duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts"))
def q_raw_flows(spark, d):
    """B1: log text coerced to numbers ('-' -> NULL)."""
    return raw(spark, d)


@query("clean_flows", f"WITH {V.CLEAN} SELECT * FROM clean",
       doubles=("duration", "orig_bytes", "orig_pkts", "resp_pkts", "total_pkts", "log_total_pkts",
                "orig_bytes_per_pkt", "pkts_ratio"))
def q_clean_flows(spark, d):
    """The whole cleaning chain: B1, B9-B11, D1-D4, B2-B8, B14."""
    return cleaned(spark, d)


@query("time_features", f"""WITH {V.FLOWS}
SELECT uid, CAST(hour(event_time) AS INTEGER) AS hour,
       CAST(isodow(event_time) - 1 AS INTEGER) AS day_of_week,
       CASE WHEN isodow(event_time) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend,
       time_bucket(INTERVAL 10 MINUTE, event_time) AS time_bin,
       CAST(epoch_us(event_time) AS DOUBLE) / 1e6 AS ts,
       make_timestamp(epoch_us(event_time)) AS ts_back
FROM flows""", doubles=("ts",))
def q_time_features(spark, d):
    """B2 (epoch seconds -> timestamp), B3, B4."""
    f = flows(spark, d)
    f = f.withColumn("ts", F.unix_micros(F.col("event_time").cast("timestamp")) / 1e6)
    f = C.with_event_time(f, "ts", "ts_back").withColumn("ts_back", F.col("ts_back").cast("timestamp_ntz"))
    f = C.time_bin(C.time_features(f), "event_time", "10 minutes")
    return f.select("uid", "hour", "day_of_week", "is_weekend",
                    F.col("time_bin").cast("timestamp_ntz").alias("time_bin"), "ts", "ts_back")


@query("traffic_features", f"""WITH {V.RAW}
SELECT uid, orig_bytes + resp_bytes AS total_bytes, orig_pkts + resp_pkts AS total_pkts,
       ln(1 + orig_bytes + resp_bytes) AS log_total_bytes, ln(1 + orig_pkts + resp_pkts) AS log_total_pkts,
       orig_bytes / CASE WHEN orig_pkts = 0 THEN 1 ELSE orig_pkts END AS orig_bytes_per_pkt,
       resp_bytes / CASE WHEN resp_pkts = 0 THEN 1 ELSE resp_pkts END AS resp_bytes_per_pkt,
       orig_bytes / (orig_pkts + 1) AS orig_bytes_per_pkt1,
       orig_bytes / (resp_bytes + 1) AS bytes_ratio, orig_pkts / (resp_pkts + 1) AS pkts_ratio,
       CASE WHEN orig_pkts = 0 THEN 0.1 ELSE orig_pkts END AS orig_pkts_log_axis,
       CAST(duration IS NULL AS INTEGER) AS duration_missing,
       CAST(conn_state IN ('S0', 'REJ') AND proto IN ('tcp') AS INTEGER) AS is_backscatter
FROM raw""", doubles=("total_bytes", "total_pkts", "log_total_bytes", "log_total_pkts", "orig_bytes_per_pkt",
                      "resp_bytes_per_pkt", "orig_bytes_per_pkt1", "bytes_ratio", "pkts_ratio",
                      "orig_pkts_log_axis"))
def q_traffic_features(spark, d):
    """B5-B8, B16, B18, B19."""
    r = C.bytes_per_packet(raw(spark, d), "plus_one")
    r = r.withColumnsRenamed({"orig_bytes_per_pkt": "orig_bytes_per_pkt1"}).drop("resp_bytes_per_pkt")
    f = C.ratio_features(C.bytes_per_packet(C.log1p_features(C.volume_features(r))))
    f = C.replace_value(f.withColumn("orig_pkts_log_axis", F.col("orig_pkts")), "orig_pkts_log_axis", 0, 0.1)
    f = C.backscatter_flag(C.missing_flags(f, ["duration"]), ["S0", "REJ"], ["tcp"])
    return f.select("uid", "total_bytes", "total_pkts", "log_total_bytes", "log_total_pkts",
                    "orig_bytes_per_pkt", "resp_bytes_per_pkt", "orig_bytes_per_pkt1", "bytes_ratio",
                    "pkts_ratio", "orig_pkts_log_axis", "duration_missing", "is_backscatter")


@query("label_cleanup", f"""WITH {V.LABELED}
SELECT uid, label, detailed_label,
       CASE WHEN label = 'Malicious' THEN 1 WHEN label = 'Benign' THEN 0 END AS target
FROM labeled WHERE label IN ('Benign', 'Malicious')""")
def q_label_cleanup(spark, d):
    """Split compound labels, standardise, fill detail, keep classes, 0/1 target."""
    return C.binary_target(C.keep_classes(labeled(spark, d))).select("uid", "label", "detailed_label", "target")


@query("distinct_labels", f"WITH {V.FLOWS} SELECT DISTINCT label_raw FROM flows")
def q_distinct_labels(spark, d):
    """B21."""
    return C.distinct_values(flows(spark, d), "label_raw")


@query("numeric_only", f"""WITH {V.CLEAN}
SELECT resp_p, duration, orig_bytes, orig_pkts, resp_pkts, hour, day_of_week, is_weekend, total_pkts,
       log_total_pkts, orig_bytes_per_pkt, pkts_ratio FROM clean""",
       doubles=("duration", "orig_bytes", "orig_pkts", "resp_pkts", "total_pkts", "log_total_pkts",
                "orig_bytes_per_pkt", "pkts_ratio"))
def q_numeric_only(spark, d):
    """B15 over the cleaned table."""
    return C.numeric_only(cleaned(spark, d))


# ---------------------------------------------------------------- C: profiling

_NUM = ["uid", "orig_h", "resp_p", "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts",
        "missed_bytes"]


def _describe_sql() -> str:
    parts = []
    for c in _NUM:
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean,
  stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min,
  quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50,
  quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM raw""")
    return f"WITH {V.RAW}\n" + "\nUNION ALL\n".join(parts)


@query("describe_numeric", _describe_sql(), doubles=("mean", "std", "min", "q25", "q50", "q75", "max"))
def q_describe_numeric(spark, d):
    """Count, mean, sample std, min, exact quartiles, max per numeric column."""
    return P.describe_numeric(raw(spark, d), _NUM)


_RAW_COLS = ["uid", "event_time", "orig_h", "resp_p", "proto", "conn_state", "service", "duration",
             "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "missed_bytes", "label", "detailed_label",
             "source_file"]
_TEXT = ["proto", "conn_state", "service", "label", "detailed_label", "source_file"]


def _per_column_sql(expr: str, name: str, cols, pct: str) -> str:
    rows = "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", CAST(count_if({expr.format(c=c)}) AS BIGINT) AS {name},
  count_if({expr.format(c=c)}) * 100.0 / count(*) AS {pct} FROM labeled""" for c in cols)
    return f"WITH {V.LABELED}\n{rows}"


@query("missing_report", _per_column_sql("{c} IS NULL", "missing", _RAW_COLS, "missing_pct"),
       doubles=("missing_pct",))
def q_missing_report(spark, d):
    """C2 per column."""
    return P.missing_report(labeled(spark, d).select(*_RAW_COLS))


@query("missing_summary", f"""WITH {V.LABELED}, m AS (
{" UNION ALL ".join(f"SELECT count_if({c} IS NULL) AS n FROM labeled" for c in _RAW_COLS)})
SELECT CAST(sum(n) AS BIGINT) AS total_missing,
       sum(n) * 100.0 / ((SELECT count(*) FROM labeled) * {len(_RAW_COLS)}) AS total_missing_pct,
       CAST(count_if(n > 0) AS BIGINT) AS columns_with_missing FROM m""", doubles=("total_missing_pct",))
def q_missing_summary(spark, d):
    """C2 totals: missing cells, share of all cells, columns affected."""
    return P.missing_summary(labeled(spark, d).select(*_RAW_COLS))


@query("blank_report", _per_column_sql("trim({c}) = ''", "blanks", _TEXT, "blank_pct"), doubles=("blank_pct",))
def q_blank_report(spark, d):
    """Blank text after trimming (the benign detail is '')."""
    return P.blank_report(labeled(spark, d).select(*_RAW_COLS))


@query("zero_report", _per_column_sql("{c} = 0", "zeros", _NUM, "zero_pct"), doubles=("zero_pct",))
def q_zero_report(spark, d):
    """C4: zeros per numeric column over all rows."""
    return P.zero_report(labeled(spark, d).select(*_RAW_COLS))


@query("value_counts_service", f"""WITH {V.FLOWS}
SELECT service AS value, count(*) AS count, count(*) * 100.0 / (SELECT count(*) FROM flows) AS pct
FROM flows WHERE service IS NOT NULL GROUP BY service""", doubles=("pct",))
def q_value_counts_service(spark, d):
    """Counts and share; NULL left out of the counts, kept in the denominator."""
    return P.value_counts(flows(spark, d), "service")


@query("top_ports", f"""WITH {V.FLOWS}
SELECT resp_p AS value, count(*) AS count, count(*) * 100.0 / (SELECT count(*) FROM flows) AS pct
FROM flows WHERE resp_p IS NOT NULL GROUP BY resp_p ORDER BY count DESC, value LIMIT 10""", doubles=("pct",))
def q_top_ports(spark, d):
    """Top-10 values (value breaks ties)."""
    return P.value_counts(flows(spark, d), "resp_p", top=10)


@query("detailed_label_counts", f"""WITH {V.LABELED}
SELECT detailed_label AS value, count(*) AS count, count(*) * 100.0 / (SELECT count(*) FROM labeled) AS pct
FROM labeled WHERE detailed_label IS NOT NULL GROUP BY detailed_label""", doubles=("pct",))
def q_detailed_label_counts(spark, d):
    """Detailed-label counts over all files."""
    return P.value_counts(labeled(spark, d), "detailed_label")


@query("cardinality", f"WITH {V.RAW}\n" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct FROM raw""" for c in _RAW_COLS))
def q_cardinality(spark, d):
    """Exact distinct count per column."""
    return P.cardinality(raw(spark, d).select(*_RAW_COLS))


_NM_COLS = ["duration", "orig_bytes", "resp_bytes", "service"]


@query("null_matrix", f"""WITH {V.RAW}, b AS (
  SELECT *, CAST(least(floor((uid - (SELECT min(uid) FROM raw)) * 1.0
       / greatest((SELECT max(uid) FROM raw) - (SELECT min(uid) FROM raw), 1e-300) * 20), 19) AS INTEGER) AS bucket
  FROM raw)
{" UNION ALL ".join(f"SELECT bucket, '{c}' AS \"column\", avg(CAST({c} IS NULL AS DOUBLE)) AS null_share FROM b GROUP BY bucket" for c in _NM_COLS)}""",
       doubles=("null_share",))
def q_null_matrix(spark, d):
    """Null share per 20 row-buckets along uid × column."""
    return P.null_matrix(raw(spark, d), "uid", 20, _NM_COLS)


@query("file_stats", f"""WITH {V.LABELED}
SELECT source_file, count(*) AS rows, CAST(count_if(label = 'Malicious') AS BIGINT) AS malicious,
       CAST(count_if(label = 'Benign') AS BIGINT) AS benign,
       count_if(label = 'Malicious') * 100.0 / count(*) AS malicious_pct,
       count_if(label = 'Benign') * 100.0 / count(*) AS benign_pct,
       CAST({" + ".join(f"(count_if({c} IS NULL) > 0)::INTEGER" for c in _RAW_COLS if c != "source_file")}
            AS INTEGER) AS columns_with_missing,
       CAST({" + ".join(f"count_if({c} IS NULL)" for c in _RAW_COLS if c != "source_file")} AS BIGINT)
            AS missing_total
FROM labeled GROUP BY source_file""", doubles=("malicious_pct", "benign_pct"))
def q_file_stats(spark, d):
    """Per-file rows, class counts and shares, missing columns and cells."""
    return P.file_stats(labeled(spark, d).select(*_RAW_COLS))


@query("class_share_by_file", f"""WITH {V.LABELED}, g AS (
  SELECT source_file, label, count(*) AS count FROM labeled GROUP BY source_file, label)
SELECT source_file, label, count, count * 100.0 / sum(count) OVER (PARTITION BY source_file) AS pct
FROM g""", doubles=("pct",))
def q_class_share_by_file(spark, d):
    """Class counts and share within each group."""
    return P.class_share(labeled(spark, d), "label", ["source_file"])


@query("head_per_file", f"""WITH {V.FLOWS}
SELECT source_file, uid, proto FROM (
  SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY uid) AS rn FROM flows) WHERE rn <= 10000""")
def q_head_per_file(spark, d):
    """A3: first 10,000 rows of each file by uid."""
    return logs.head_per_group(flows(spark, d), "source_file", "uid", 10_000).select("source_file", "uid", "proto")


# ---------------------------------------------------------------- D: cleaning

@query("drop_sparse_zero_columns", f"""WITH {V.RAW}
SELECT * EXCLUDE (resp_bytes, missed_bytes, detailed_label) FROM raw""",
       doubles=("duration", "orig_bytes", "orig_pkts", "resp_pkts"))
def q_drop_sparse_zero_columns(spark, d):
    """D1 (> 20 % missing) then D2 (> 95 % zeros): data-driven column drops."""
    return D.drop_constant_zero(D.drop_sparse_columns(raw(spark, d), 0.20), 0.95)


@query("impute_median_mode", f"""WITH {V.RAW}
SELECT uid,
       coalesce(duration, (SELECT median(duration) FROM raw)) AS duration,
       coalesce(orig_bytes, (SELECT median(orig_bytes) FROM raw)) AS orig_bytes,
       coalesce(resp_bytes, (SELECT median(resp_bytes) FROM raw)) AS resp_bytes,
       coalesce(service, (SELECT service FROM raw WHERE service IS NOT NULL
                          GROUP BY service ORDER BY count(*) DESC, service LIMIT 1)) AS service
FROM raw""", doubles=("duration", "orig_bytes", "resp_bytes"))
def q_impute_median_mode(spark, d):
    """D3 (exact median) and D4 (mode, smallest on ties)."""
    r = raw(spark, d).select("uid", "duration", "orig_bytes", "resp_bytes", "service")
    return D.impute_mode(D.impute_median(r, ["duration", "orig_bytes", "resp_bytes"]), ["service"])


@query("impute_zero_constant", f"""WITH {V.RAW}
SELECT uid, coalesce(orig_bytes, 0) AS orig_bytes, coalesce(resp_bytes, 0) AS resp_bytes,
       coalesce(service, 'unknown') AS service FROM raw""", doubles=("orig_bytes", "resp_bytes"))
def q_impute_zero_constant(spark, d):
    """D5, D6."""
    r = raw(spark, d).select("uid", "orig_bytes", "resp_bytes", "service")
    return D.fill_constant(D.impute_zero(r, ["orig_bytes", "resp_bytes"]), "unknown", ["service"])


@query("impute_group_median", f"""WITH {V.RAW}, g AS (
  SELECT proto, conn_state, median(duration) AS gm FROM raw GROUP BY proto, conn_state)
SELECT r.uid, r.proto, r.conn_state,
       coalesce(r.duration, g.gm, (SELECT median(duration) FROM raw)) AS duration
FROM raw r LEFT JOIN g ON r.proto = g.proto AND r.conn_state = g.conn_state""", doubles=("duration",))
def q_impute_group_median(spark, d):
    """NULL duration -> median within (proto, conn_state)."""
    r = raw(spark, d).select("uid", "proto", "conn_state", "duration")
    return D.impute_group_median(r, "duration", ["proto", "conn_state"])


@query("iqr_outliers", f"""WITH li AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_tax FROM lineitem),
q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a1, quantile_cont(l_extendedprice, 0.75) AS a3,
             quantile_cont(l_tax, 0.25) AS t1, quantile_cont(l_tax, 0.75) AS t3 FROM li)
SELECT l_orderkey, l_linenumber,
       CAST(l_extendedprice < a1 - 1.5 * (a3 - a1) OR l_extendedprice > a3 + 1.5 * (a3 - a1) AS INTEGER)
         AS l_extendedprice_outlier,
       CAST(l_tax < t1 - 1.5 * (t3 - t1) OR l_tax > t3 + 1.5 * (t3 - t1) AS INTEGER) AS l_tax_outlier,
       least(l_extendedprice, a3 + 1.5 * (a3 - a1)) AS capped_price
FROM li, q""", doubles=("capped_price",))
def q_iqr_outliers(spark, d):
    """IQR flags (both sides) and the upper cap, exact quartiles, over lineitem."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")
    q = D.quartiles(li, ["l_extendedprice", "l_tax"])  # fitted once, applied twice
    f = D.iqr_flag(li, ["l_extendedprice", "l_tax"], bounds=q)
    f = f.withColumn("capped_price", F.col("l_extendedprice"))
    f = D.iqr_cap(f, ["capped_price"], bounds={"capped_price": q["l_extendedprice"]})
    return f.select("l_orderkey", "l_linenumber", "l_extendedprice_outlier", "l_tax_outlier", "capped_price")


@query("zscore_outliers", """WITH o AS (SELECT o_orderkey, o_totalprice FROM orders),
s AS (SELECT avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd FROM o)
SELECT o_orderkey, (o_totalprice - mu) / sd AS o_totalprice_z,
       CAST(abs((o_totalprice - mu) / sd) > 3 AS INTEGER) AS o_totalprice_zflag FROM o, s""",
       doubles=("o_totalprice_z",))
def q_zscore_outliers(spark, d):
    """Z-score with the population std, flag |z| > 3, over orders."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return D.zscore_flag(o, ["o_totalprice"]).drop("o_totalprice")


# ---------------------------------------------------------------- E: statistics

def _xtab_sql(row: str, norm: str) -> str:
    base = f"""WITH {V.CLEAN}, c AS (
  SELECT {row}, CAST(count_if(label = 'Benign') AS BIGINT) AS b, CAST(count_if(label = 'Malicious') AS BIGINT) AS m
  FROM clean WHERE {row} IS NOT NULL AND label IS NOT NULL GROUP BY {row})"""
    if norm == "index":
        return base + f"""
SELECT {row}, b * 100.0 / (b + m) AS "Benign", m * 100.0 / (b + m) AS "Malicious",
       b * 100.0 / (b + m) AS "cum_Benign", (b + m) * 100.0 / (b + m) AS "cum_Malicious" FROM c"""
    if norm == "columns":
        return base + f"""
SELECT {row}, b * 100.0 / (SELECT sum(b) FROM c) AS "Benign", m * 100.0 / (SELECT sum(m) FROM c) AS "Malicious"
FROM c"""
    return base + f"""
SELECT {row}, b * 100.0 / (SELECT sum(b + m) FROM c) AS "Benign", m * 100.0 / (SELECT sum(b + m) FROM c)
       AS "Malicious" FROM c"""


@query("crosstab_proto_label", _xtab_sql("proto", "index"),
       doubles=("Benign", "Malicious", "cum_Benign", "cum_Malicious"))
def q_crosstab_proto_label(spark, d):
    """E1 (row-normalised ×100) with E3 running sums along each row."""
    x = S.crosstab_pct(cleaned(spark, d), "proto", "label", LABELS, "index")
    return S.with_cumulative(x, LABELS)


@query("crosstab_conn_state_label", _xtab_sql("conn_state", "columns"), doubles=("Benign", "Malicious"))
def q_crosstab_conn_state_label(spark, d):
    """Column-normalised (share of each class per state)."""
    return S.crosstab_pct(cleaned(spark, d), "conn_state", "label", LABELS, "columns")


@query("crosstab_service_label", _xtab_sql("service", "all"), doubles=("Benign", "Malicious"))
def q_crosstab_service_label(spark, d):
    """Normalised by the grand total."""
    return S.crosstab_pct(cleaned(spark, d), "service", "label", LABELS, "all")


@query("hourly_volume", f"""WITH {V.CLEAN}
SELECT hour, CAST(nullif(count_if(label = 'Benign'), 0) AS BIGINT) AS "Benign",
       CAST(nullif(count_if(label = 'Malicious'), 0) AS BIGINT) AS "Malicious"
FROM clean WHERE label IS NOT NULL GROUP BY hour""")
def q_hourly_volume(spark, d):
    """Connections per hour × label; absent cells NULL."""
    f = C.time_features(labeled(spark, d))
    return S.hourly_volume(f, "event_time", "label", LABELS)


@query("volume_series", f"""WITH {V.LABELED}
SELECT time_bucket(INTERVAL 10 MINUTE, event_time) AS time_bin,
       CAST(count_if(label = 'Benign') AS BIGINT) AS "Benign",
       CAST(count_if(label = 'Malicious') AS BIGINT) AS "Malicious"
FROM labeled WHERE label IS NOT NULL GROUP BY 1""")
def q_volume_series(spark, d):
    """E5: connections per 10-minute bin × label; absent cells 0."""
    v = S.volume_series(labeled(spark, d), "event_time", "label", "10 minutes", LABELS)
    return v.withColumn("time_bin", F.col("time_bin").cast("timestamp_ntz"))


_CORR = ["duration", "orig_bytes", "orig_pkts", "resp_pkts", "total_pkts", "pkts_ratio", "hour", "resp_p"]


def _corr_sql() -> str:
    cols = _CORR + ["target"]
    pairs = []
    for a in cols:
        for b in cols:
            pairs.append(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM t")
    return (f"WITH {V.CLEAN}, t AS (SELECT *, CASE WHEN label = 'Malicious' THEN 1.0 ELSE 0.0 END AS target "
            f"FROM clean WHERE label IN ('Benign', 'Malicious'))\n" + "\nUNION ALL\n".join(pairs))


@query("correlation_matrix", _corr_sql(), doubles=("r",))
def q_correlation_matrix(spark, d):
    """Pairwise Pearson matrix, long form; constant columns give NULL."""
    f = C.binary_target(C.keep_classes(cleaned(spark, d))).withColumn("target", F.col("target").cast("double"))
    return S.correlation_matrix(f, _CORR + ["target"])


@query("correlation_top", f"""WITH {V.CLEAN}, t AS (
  SELECT *, CASE WHEN label = 'Malicious' THEN 1.0 ELSE 0.0 END AS target FROM clean
  WHERE label IN ('Benign', 'Malicious')),
r AS ({" UNION ALL ".join(f"SELECT '{c}' AS f, abs(corr({c}, target)) AS ar FROM t" for c in _CORR)}),
k AS (SELECT f FROM r ORDER BY ar DESC NULLS LAST, f LIMIT 4)
SELECT f AS a FROM k""")
def q_correlation_top(spark, d):
    """With more columns than ``top``, the ``top`` largest |r(target)| are kept."""
    f = C.binary_target(C.keep_classes(cleaned(spark, d))).withColumn("target", F.col("target").cast("double"))
    return S.correlation_matrix(f, _CORR, target="target", top=4).select("a").distinct()


@query("class_centroids", f"""WITH {V.CLEAN}
SELECT label, avg(orig_pkts) AS orig_pkts, avg(resp_pkts) AS resp_pkts, avg(duration) AS duration
FROM clean GROUP BY label""", doubles=("orig_pkts", "resp_pkts", "duration"))
def q_class_centroids(spark, d):
    """Class means."""
    return S.class_centroids(cleaned(spark, d), "label", ["orig_pkts", "resp_pkts", "duration"])


@query("histogram", """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT l_returnflag, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((l_extendedprice - lo) / ((hi - lo) / 10)), 9) END AS INTEGER) AS bin, lo, hi
      FROM lineitem, s WHERE l_extendedprice IS NOT NULL)
SELECT l_returnflag, bin, lo + bin * (hi - lo) / 10 AS lo, lo + (bin + 1) * (hi - lo) / 10 AS hi, count(*) AS count
FROM b GROUP BY l_returnflag, bin, b.lo, b.hi""", doubles=("lo", "hi"))
def q_histogram(spark, d):
    """10 equal-width bins of the price per return flag."""
    return S.histogram(read_table(spark, d, "lineitem"), "l_extendedprice", 10, by="l_returnflag")


@query("kde_bytes", f"""WITH {V.CLEAN}, base AS (
  SELECT label, log10(CASE WHEN orig_bytes = 0 THEN 0.1 ELSE orig_bytes END) AS v FROM clean
  WHERE orig_bytes IS NOT NULL),
st AS (SELECT label, count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM base GROUP BY label),
st2 AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS h FROM st),
st3 AS (SELECT *, lo - 3.0 * h AS glo, hi + 3.0 * h AS ghi, greatest((hi - lo) / 4096, 1e-12) AS fw FROM st2),
b AS (SELECT base.label, least(floor((v - lo) / fw), 4095) AS bi, count(*) AS w, avg(v) AS c
      FROM base JOIN st3 ON base.label = st3.label GROUP BY base.label, bi),
p AS (SELECT b.label, t.g, glo + t.g * (ghi - glo) / 199 AS x, w, c, h, n
      FROM b JOIN st3 ON b.label = st3.label, (SELECT unnest(generate_series(0, 199)) AS g) t)
SELECT label, x, sum(w * exp(-0.5 * ((x - c) / h) * ((x - c) / h)) / (n * h * {math.sqrt(2 * math.pi)!r}))
       AS density FROM p GROUP BY label, g, x""", doubles=("x", "density"))
def q_kde_bytes(spark, d):
    """Binned Gaussian KDE of log10(orig_bytes) per class (also tested against numpy)."""
    return S.kde(cleaned(spark, d), "orig_bytes", by="label", grid=200)


@query("top_sources", """SELECT l_suppkey, sum(l_extendedprice) AS revenue FROM lineitem
GROUP BY l_suppkey ORDER BY revenue DESC, l_suppkey LIMIT 15""", doubles=("revenue",))
def q_top_sources(spark, d):
    """H1/H2: top 15 by a sum (partial top-n per task, no global sort)."""
    g = read_table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("revenue"))
    return S.top_n(g, "revenue", 15, tie="l_suppkey")


@query("dense_view_profile", f"""WITH {V.LINEFLOWS}
SELECT conn_state, label, count(*) AS count, count(DISTINCT orig_h) AS sources,
       avg(orig_bytes) AS mean_bytes FROM lineflows GROUP BY conn_state, label""", doubles=("mean_bytes",))
def q_dense_view_profile(spark, d):
    """The dense lineitem flow view, grouped (a check of the view itself)."""
    f = flows_from_lineitem(read_table(spark, d, "lineitem"))
    return f.groupBy("conn_state", "label").agg(F.count(F.lit(1)).alias("count"),
                                               F.count_distinct("orig_h").alias("sources"),
                                               F.avg("orig_bytes").alias("mean_bytes"))


@query("file_heads_stats", f"""WITH {V.LABELED}, h AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY uid) AS rn FROM labeled)
  WHERE rn <= 10000)
SELECT source_file, count(*) AS rows, CAST(count_if(label = 'Malicious') AS BIGINT) AS malicious,
       CAST(count_if(label = 'Benign') AS BIGINT) AS benign,
       count_if(label = 'Malicious') * 100.0 / count(*) AS malicious_pct,
       count_if(label = 'Benign') * 100.0 / count(*) AS benign_pct,
       CAST({" + ".join(f"(count_if({c} IS NULL) > 0)::INTEGER" for c in _RAW_COLS if c != "source_file")}
            AS INTEGER) AS columns_with_missing,
       CAST({" + ".join(f"count_if({c} IS NULL)" for c in _RAW_COLS if c != "source_file")} AS BIGINT)
            AS missing_total
FROM h GROUP BY source_file""", doubles=("malicious_pct", "benign_pct"))
def q_file_heads_stats(spark, d):
    """The multi-file comparison: A3 (first 10,000 rows of each file) then C9."""
    heads = logs.head_per_group(labeled(spark, d).select(*_RAW_COLS), "source_file", "uid", 10_000)
    return P.file_stats(heads)


# fixed values: Spark's type names of the labelled view's columns
_RAW_TYPES = {"uid": "bigint", "event_time": "timestamp_ntz", "orig_h": "bigint", "resp_p": "int",
              "proto": "string", "conn_state": "string", "service": "string", "duration": "double",
              "orig_bytes": "double", "resp_bytes": "double", "orig_pkts": "double", "resp_pkts": "double",
              "missed_bytes": "bigint", "label": "string", "detailed_label": "string", "source_file": "string"}


def _profile_sql() -> str:
    parts = []
    for c in _RAW_COLS:
        blank = f"CAST(count_if(trim({c}) = '') AS BIGINT)" if c in _TEXT else "CAST(NULL AS BIGINT)"
        zero = f"CAST(count_if({c} = 0) AS BIGINT)" if c in _NUM else "CAST(NULL AS BIGINT)"
        parts.append(f"""SELECT '{c}' AS "column", '{_RAW_TYPES[c]}' AS dtype, count(*) AS rows,
  CAST(count_if({c} IS NULL) AS BIGINT) AS missing, {blank} AS blanks, {zero} AS zeros FROM labeled""")
    return f"WITH {V.LABELED}\n" + "\nUNION ALL\n".join(parts)


@query("column_profile", _profile_sql())
def q_column_profile(spark, d):
    """C1-C4 in one pass: names, types, rows, missing, blank and zero counts of every column."""
    return P.column_profile(labeled(spark, d).select(*_RAW_COLS))
