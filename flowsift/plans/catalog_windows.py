"""Checkable queries for the per-source window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsift.operators import windows as G
from flowsift.plans import oracle_views as V
from flowsift.plans.catalog_core import labeled
from flowsift.plans.registry import query
from flowsift.sources.views import flows, read_table

DAY = 86_400


@query("rolling_source_features", f"""WITH {V.FLOWS}
SELECT uid, count(*) OVER w AS conn_rate_1d, count(DISTINCT resp_p) OVER w AS ports_1d FROM flows
WINDOW w AS (PARTITION BY orig_h ORDER BY event_time RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""")
def q_rolling_source_features(spark, d):
    """G1 + G2 over a one-day trailing window (the events view is sparse)."""
    f = G.source_window_features(flows(spark, d), "orig_h", "event_time", "resp_p", DAY,
                                 "conn_rate_1d", "ports_1d")
    return f.select("uid", "conn_rate_1d", "ports_1d")


@query("rolling_count_5min", f"""WITH {V.FLOWS}
SELECT uid, count(*) OVER (PARTITION BY orig_h ORDER BY event_time
       RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND CURRENT ROW) AS conn_rate_5min FROM flows""")
def q_rolling_count_5min(spark, d):
    """G1 with the thesis's five-minute window."""
    return G.rolling_count(flows(spark, d), "orig_h", "event_time", 300, "conn_rate_5min").select(
        "uid", "conn_rate_5min")


@query("rolling_dense_features", """
SELECT l_orderkey AS uid, l_linenumber, count(*) OVER w AS conn_rate_30d,
       count(DISTINCT l_partkey) OVER w AS parts_30d
FROM lineitem
WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)""")
def q_rolling_dense_features(spark, d):
    """G1 + G2 on the dense lineitem view (supplier = source, part = port): many
    rows per source and day, 30-day window cut into 45-day chunks (exercises
    the halo copies)."""
    li = read_table(spark, d, "lineitem")
    f = li.select(F.col("l_orderkey").alias("uid"), "l_linenumber", F.col("l_shipdate").alias("event_time"),
                  F.col("l_suppkey").alias("orig_h"), F.col("l_partkey").alias("resp_p"))
    out = G.source_window_features(f, "orig_h", "event_time", "resp_p", 30 * DAY, "conn_rate_30d", "parts_30d",
                                   chunk_seconds=45 * DAY)
    return out.select("uid", "l_linenumber", "conn_rate_30d", "parts_30d")


@query("gap_stats", f"""WITH {V.FLOWS},
g AS (SELECT orig_h, epoch_us(event_time) - lag(epoch_us(event_time)) OVER (PARTITION BY orig_h ORDER BY event_time)
             AS gap FROM flows),
s AS (SELECT orig_h, avg(gap) / 1e6 AS time_delta_mean, stddev_samp(gap) / 1e6 AS time_delta_std
      FROM g GROUP BY orig_h)
SELECT f.uid, s.time_delta_mean, s.time_delta_std FROM flows f LEFT JOIN s ON f.orig_h = s.orig_h""",
       doubles=("time_delta_mean", "time_delta_std"))
def q_gap_stats(spark, d):
    """Inter-arrival mean / sample std per source, on every row (chunked by day)."""
    return G.gap_stats(flows(spark, d), "orig_h", "event_time").select(
        "uid", "time_delta_mean", "time_delta_std")


@query("window_counts_tumbling", f"""WITH {V.FLOWS}
SELECT orig_h, time_bucket(INTERVAL 1 HOUR, event_time) AS window_start,
       time_bucket(INTERVAL 1 HOUR, event_time) + INTERVAL 1 HOUR AS window_end,
       count(*) AS connections, count(DISTINCT resp_p) AS distinct_resp_p
FROM flows GROUP BY 1, 2, 3""")
def q_window_counts_tumbling(spark, d):
    """Per source and hour."""
    w = G.window_counts(flows(spark, d), "orig_h", "event_time", "1 hour", val="resp_p")
    return w.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")) \
        .withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@query("window_counts_sliding", """WITH li AS (SELECT l_suppkey, l_shipdate FROM lineitem),
x AS (SELECT l_suppkey, time_bucket(INTERVAL 5 DAY, l_shipdate, TIMESTAMP '1970-01-01') - k * INTERVAL 5 DAY AS ws
      FROM li, (SELECT unnest(generate_series(0, 1)) AS k))
SELECT l_suppkey, ws AS window_start, ws + INTERVAL 10 DAY AS window_end, count(*) AS connections
FROM x GROUP BY 1, 2, 3""")
def q_window_counts_sliding(spark, d):
    """G4 sliding: 10-day windows every 5 days per supplier (each row in two windows)."""
    w = G.window_counts(read_table(spark, d, "lineitem"), "l_suppkey", "l_shipdate", "10 days", "5 days")
    return w.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")) \
        .withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@query("failed_ratio", f"""WITH {V.FLOWS}, g AS (
  SELECT time_bucket(INTERVAL 1 HOUR, event_time) AS window_start,
         CAST(count_if(conn_state IN ('S0', 'REJ')) AS BIGINT) AS failed,
         CAST(count_if(conn_state IN ('SF')) AS BIGINT) AS succeeded
  FROM flows GROUP BY 1)
SELECT *, CASE WHEN succeeded = 0 THEN NULL ELSE failed / succeeded END AS failed_ratio,
       CASE WHEN succeeded = 0 THEN NULL ELSE failed / succeeded END
       - lag(CASE WHEN succeeded = 0 THEN NULL ELSE failed / succeeded END) OVER (ORDER BY window_start)
       AS ratio_change FROM g""", doubles=("failed_ratio", "ratio_change"))
def q_failed_ratio(spark, d):
    """failed/successful ratio per hour and its rise."""
    return G.failed_ratio(flows(spark, d), "event_time", "1 hour").withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz"))


@query("protocol_share_series", f"""WITH {V.FLOWS}, g AS (
  SELECT time_bucket(INTERVAL 1 HOUR, event_time) AS window_start, proto, count(*) AS count
  FROM flows WHERE proto IS NOT NULL GROUP BY 1, 2),
s AS (SELECT *, count / sum(count) OVER (PARTITION BY window_start) AS share FROM g)
SELECT *, share - lag(share) OVER (PARTITION BY proto ORDER BY window_start) AS share_change FROM s""",
       doubles=("share", "share_change"))
def q_protocol_share_series(spark, d):
    """Protocol shares per hour and change against the previous hour."""
    return G.share_series(flows(spark, d), "event_time", "proto", "1 hour").withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz"))


@query("low_volume_share", f"""WITH {V.LABELED}
SELECT time_bucket(INTERVAL 1 HOUR, event_time) AS window_start,
       avg(orig_bytes / CASE WHEN orig_pkts = 0 THEN 1 ELSE orig_pkts END) AS bytes_per_pkt,
       count_if(coalesce(orig_bytes, 0) <= 500 AND coalesce(orig_pkts, 0) <= 2) / count(*) AS low_volume_share
FROM labeled GROUP BY 1""", doubles=("bytes_per_pkt", "low_volume_share"))
def q_low_volume_share(spark, d):
    """Bytes per packet and the low-volume share per hour."""
    return G.low_volume_share(labeled(spark, d), "event_time", "1 hour", max_bytes=500, max_pkts=2).withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz"))


@query("scanning_flag", f"""WITH {V.RAW}, r AS (
  SELECT uid, orig_bytes, resp_bytes, count(*) OVER (PARTITION BY orig_h ORDER BY event_time
         RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS conn_rate FROM raw)
SELECT uid, conn_rate,
       CAST(conn_rate >= 3 AND coalesce(orig_bytes + resp_bytes, 0) <= 2000 AS INTEGER) AS is_scanning_behavior
FROM r""")
def q_scanning_flag(spark, d):
    """Many connections in the window (G1) carrying few bytes."""
    from flowsift.functions import columns as C
    from flowsift.plans.catalog_core import raw
    r = C.volume_features(raw(spark, d))
    r = G.rolling_count(r, "orig_h", "event_time", DAY, "conn_rate")
    return C.scanning_flag(r, 3, 2000, "conn_rate", "total_bytes").select("uid", "conn_rate", "is_scanning_behavior")


@query("rolling_source_features_prefix", f"""WITH {V.FLOWS}
SELECT uid, count(*) OVER w AS conn_rate_1d, count(DISTINCT resp_p) OVER w AS ports_1d FROM flows
WINDOW w AS (PARTITION BY orig_h ORDER BY event_time RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""")
def q_rolling_source_features_prefix(spark, d):
    """G1 + G2, prefix-sum form (tasks bounded by one-hour chunks, whatever the window)."""
    f = G.source_window_features_prefix(flows(spark, d), "orig_h", "event_time", "resp_p", DAY,
                                        "conn_rate_1d", "ports_1d", chunk_seconds=3600)
    return f.select("uid", "conn_rate_1d", "ports_1d")


@query("rolling_dense_features_prefix", """
SELECT l_orderkey AS uid, l_linenumber, count(*) OVER w AS conn_rate_30d,
       count(DISTINCT l_partkey) OVER w AS parts_30d
FROM lineitem
WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)""")
def q_rolling_dense_features_prefix(spark, d):
    """G1 + G2 on the dense view, prefix-sum form with 2-day chunks (15 per window)."""
    li = read_table(spark, d, "lineitem")
    f = li.select(F.col("l_orderkey").alias("uid"), "l_linenumber", F.col("l_shipdate").alias("event_time"),
                  F.col("l_suppkey").alias("orig_h"), F.col("l_partkey").alias("resp_p"))
    out = G.source_window_features_prefix(f, "orig_h", "event_time", "resp_p", 30 * DAY, "conn_rate_30d",
                                          "parts_30d", chunk_seconds=2 * DAY)
    return out.select("uid", "l_linenumber", "conn_rate_30d", "parts_30d")
