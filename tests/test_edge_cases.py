"""Hand-sized inputs for the awkward cases (FIXTURES.md §2)."""

import datetime as dt
import math
import os
import tempfile

from pyspark.sql import functions as F

from flowsift.functions import columns as C
from flowsift.operators import clean as D
from flowsift.operators import evaluate as N
from flowsift.operators import profile as P
from flowsift.operators import windows as G
from flowsift.sources import logs


def test_coerce_numeric_dash_empty_nan(spark):
    df = spark.createDataFrame([("1.5",), ("-",), ("",), ("NaN",), (" 7",)], "duration string")
    got = [r[0] for r in C.coerce_numeric(df, ["duration"]).collect()]
    assert got[0] == 1.5 and got[1] is None and got[2] is None and got[3] is None


def test_sparse_rule_is_strict(spark):
    # a: exactly 20 % missing (kept), b: 40 % missing (dropped)
    rows = [(1.0 if i else None, 1.0 if i > 1 else None) for i in range(5)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert D.drop_sparse_columns(df, 0.20).columns == ["a"]


def test_zero_rule_is_strict(spark):
    rows = [(0 if i < 19 else 1, 0 if i < 20 else 1) for i in range(21)]  # 90.5 % and 95.2 % zeros
    df = spark.createDataFrame(rows, "a int, b int")
    assert D.drop_constant_zero(df, 0.95).columns == ["a"]
    rows = [(0 if i < 19 else 1,) for i in range(20)]  # exactly 95 %
    assert D.drop_constant_zero(spark.createDataFrame(rows, "a int"), 0.95).columns == ["a"]


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert sorted(r[0] for r in D.impute_mode(df, ["s"]).collect()) == ["a", "a", "a", "b", "b"]


def test_median_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,), (None,)], "x double")
    assert sorted(r[0] for r in D.impute_median(df).collect()) == [1.0, 2.0, 6.0, 10.0, 20.0]


def test_bytes_per_packet_zero_packets(spark):
    df = spark.createDataFrame([(10.0, 0.0, 5.0, 0.0)], "orig_bytes double, orig_pkts double, "
                               "resp_bytes double, resp_pkts double")
    r = C.bytes_per_packet(df).first()
    assert r["orig_bytes_per_pkt"] == 10.0 and r["resp_bytes_per_pkt"] == 5.0
    r = C.bytes_per_packet(df, "plus_one").first()
    assert r["orig_bytes_per_pkt"] == 10.0


def test_weekend_boundaries(spark):
    sat = dt.datetime(2024, 1, 6, 23, 59, 59)
    sun = dt.datetime(2024, 1, 7, 0, 0, 0)
    mon = dt.datetime(2024, 1, 8, 0, 0, 0)
    df = spark.createDataFrame([(sat,), (sun,), (mon,)], "event_time timestamp_ntz")
    got = [(r["hour"], r["day_of_week"], r["is_weekend"]) for r in C.time_features(df).collect()]
    assert got == [(23, 5, 1), (0, 6, 1), (0, 0, 0)]


def test_epoch_seconds_keep_micros(spark):
    df = spark.createDataFrame([(1704067200.123456,)], "ts double")
    t = C.with_event_time(df, "ts").first()["event_time"]
    assert t.microsecond == 123456


def test_compound_labels(spark):
    rows = [("Malicious PartOfAHorizontalPortScan", None),   # one blank: not split
            ("Malicious  C&C", None),                          # two blanks
            ("Malicious     DDoS", "Attack"),                  # five blanks, detail kept
            ("  Benign  ", None), ("Unknown", None), (None, None)]
    df = spark.createDataFrame(rows, "label string, detailed_label string")
    got = [(r["label"], r["detailed_label"]) for r in C.clean_labels(df).collect()]
    assert got[0] == ("Malicious", "unknown")
    assert got[1] == ("Malicious", "C&C")
    assert got[2] == ("Malicious", "Attack")
    assert got[3] == ("Benign", "")
    assert got[4] == ("Unknown", None)
    assert C.keep_classes(C.clean_labels(df)).count() == 4
    tgt = [r["target"] for r in C.binary_target(C.clean_labels(df)).collect()]
    assert tgt[:4] == [1, 1, 1, 0] and tgt[4] is None


def test_rolling_ties_and_exact_boundary(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, 1, base, 80), (2, 1, base, 80), (3, 1, base + dt.timedelta(seconds=300), 443),
            (4, 1, base + dt.timedelta(seconds=301), 22), (5, 2, base, 80)]
    df = spark.createDataFrame(rows, "uid long, src long, event_time timestamp_ntz, port int")
    for fn in (G.source_window_features, G.source_window_features_prefix):
        out = {r["uid"]: (r["conn_rate_5min"], r["port_scan_score"])
               for r in fn(df, "src", "event_time", "port", 300, chunk_seconds=60).collect()}
        # two rows with one timestamp see each other; 300 s is inside the window, 301 s is not
        assert out == {1: (2, 1), 2: (2, 1), 3: (3, 2), 4: (2, 2), 5: (1, 1)}, fn.__name__


def test_gap_stats_single_and_pair(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, 1, base), (2, 1, base + dt.timedelta(seconds=10)), (3, 1, base + dt.timedelta(seconds=40)),
            (4, 2, base), (5, 3, base), (6, 3, base + dt.timedelta(hours=5))]
    df = spark.createDataFrame(rows, "uid long, src long, event_time timestamp_ntz")
    out = {r["uid"]: (r["time_delta_mean"], r["time_delta_std"])
           for r in G.gap_stats(df, "src", "event_time", chunk_seconds=15).collect()}
    assert out[1][0] == 20.0 and math.isclose(out[1][1], math.sqrt(200))
    assert out[4] == (None, None)
    assert out[5] == (18000.0, None)


def test_metrics_zero_denominators_and_one_class(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2)], "label int, prediction int, score double")
    r = N.binary_metrics(df).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 1.0)
    a = N.auc(df).first()
    assert a["auc_trapezoid"] == 0.0


def test_auc_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    a = N.auc(df).first()
    assert a["auc_trapezoid"] == 0.875 and a["auc_rank"] == 0.75


def test_value_counts_null_in_denominator(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    got = {r["value"]: (r["count"], r["pct"]) for r in P.value_counts(df, "v").collect()}
    assert got == {"a": (2, 50.0), "b": (1, 25.0)}


def test_read_flows_two_headers(spark):
    d = tempfile.mkdtemp(prefix="flowsift-logs-", dir="/tmp")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("ts|id.orig_h|id.resp_p|duration|label\n1.5|10.0.0.1|80|-|Benign\n2.5|10.0.0.2|22|0.5|Malicious\n")
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("ts|id.orig_h|detailed-label|label\n3.0|10.0.0.3|C&C|Malicious\n")
    df = logs.read_flows(spark, d)
    assert set(df.columns) >= {"ts", "orig_h", "resp_p", "duration", "detailed_label", "label", "source_file"}
    rows = {r["orig_h"]: r for r in df.collect()}
    assert rows["10.0.0.1"]["duration"] is None and rows["10.0.0.2"]["duration"] == 0.5
    assert rows["10.0.0.3"]["resp_p"] is None and rows["10.0.0.3"]["detailed_label"] == "C&C"
    assert rows["10.0.0.1"]["source_file"] == "a.csv" and rows["10.0.0.1"]["resp_p"] == 80
    assert dict(df.dtypes)["ts"] == "double"


def test_write_and_merge_metrics(spark):
    d = tempfile.mkdtemp(prefix="flowsift-metrics-", dir="/tmp")
    a = spark.createDataFrame([("rf", 0.9), ("gbt", 0.8)], "model string, f1 double")
    b = spark.createDataFrame([("mlp", 0.7, 0.1), ("rf", 0.95, 0.2)], "model string, f1 double, bce double")
    logs.write_metrics(a, d + "/m")
    back = logs.read_metrics(spark, d + "/m")
    merged = {r["model"]: r["f1"] for r in logs.merge_metrics(back, b).collect()}
    assert merged == {"rf": 0.95, "gbt": 0.8, "mlp": 0.7}


def test_head_per_group(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    out = logs.head_per_group(df, "g", "id", 5)
    assert out.count() == 15
    assert sorted(r["id"] for r in out.filter("g = 0").collect()) == [0, 3, 6, 9, 12]


def test_window_math_ignores_session_zone(spark):
    base = dt.datetime(2024, 3, 10, 1, 30)  # a DST change in New York follows 30 minutes later
    rows = [(1, 1, base), (2, 1, base + dt.timedelta(hours=2))]
    df = spark.createDataFrame(rows, "uid long, src long, event_time timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        out = {r["uid"]: r["time_delta_mean"] for r in G.gap_stats(df, "src", "event_time").collect()}
        cnt = {r["uid"]: r["n"] for r in G.rolling_count(df, "src", "event_time", 3600 + 1800, "n").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert out[1] == 7200.0 and cnt == {1: 1, 2: 1}


def test_all_null_column_dropped(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b double")
    assert D.drop_sparse_columns(df, 0.20).columns == ["a"]


def test_read_flows_single_header_path(spark):
    d = tempfile.mkdtemp(prefix="flowsift-logs-", dir="/tmp")
    for name, rows in (("a.csv", "1.5|10.0.0.1|80|-\n"), ("b.csv", "2.5|10.0.0.2|22|0.5\n")):
        with open(os.path.join(d, name), "w") as f:
            f.write("ts|id.orig_h|id.resp_p|duration\n" + rows)
    df = logs.read_flows(spark, d, mixed_headers=False)
    got = {r["orig_h"]: (r["resp_p"], r["duration"], r["source_file"]) for r in df.collect()}
    assert got == {"10.0.0.1": (80, None, "a.csv"), "10.0.0.2": (22, 0.5, "b.csv")}
