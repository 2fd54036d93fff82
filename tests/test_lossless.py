"""Rows with NULL keys, times and classes stay; every form gives the same rows."""

import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from flowsift.functions.quantiles import exact_quantiles
from flowsift.operators import clean, reduce, sample, windows
from flowsift.operators import encode as J
from flowsift.operators.evaluate import auc
from flowsift.operators.smote import smote
from flowsift.sources.logs import read_flows
from flowsift.streaming import features as S

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rows = [(i, None if i % 4 == 0 else f"10.0.0.{i % 3}", None if i % 5 == 0 else T0 + dt.timedelta(seconds=7 * i), i % 6)
            for i in range(40)]
    return spark.createDataFrame(rows, "uid long, orig_h string, ts timestamp, port int")


def test_window_forms_keep_null_keys_and_times(events):
    def rows(method):
        out = windows.source_window_features(events, "orig_h", "ts", "port", 60, method=method, chunk_seconds=20)
        return sorted((r.uid, r.conn_rate_5min, r.port_scan_score) for r in out.collect())
    halo, prefix = rows("halo"), rows("prefix")
    assert halo == prefix and len(halo) == 40
    assert all((r[1] is None) == (r[0] % 5 == 0) for r in halo)
    assert rows("auto") == halo
    assert windows.rolling_count(events, "orig_h", "ts", 60, max_task_rows=3).count() == 40


def test_splits_and_folds_keep_a_null_class(events):
    out = sample.stratified_split(events, "orig_h").collect()
    assert len(out) == 40 and sum(r.orig_h is None and r.split == "train" for r in out) == 8
    assert sample.assign_folds(events, "orig_h", k=5).count() == 40
    assert sample.class_weights(events, "orig_h").filter("weight is null").count() == 0


def test_grouped_quantiles_agree(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("b", None), ("b", float("nan"))], "k string, v double")
    got = [sorted((r.k or "", r.value if r.value is not None else -1.0) for r in
                  exact_quantiles(df, ["v"], [0.5], ["k"], method=m).collect()) for m in ("map", "select")]
    assert got[1] == [("", 2.0), ("a", 2.0), ("b", -1.0)]
    assert [x for x in got[0] if x[0] != "b"] == got[1][:2]


def test_auc_of_counts_beyond_bigint(spark, monkeypatch):
    from flowsift.operators import evaluate
    big = 4 * 10 ** 9
    counts = spark.createDataFrame([(0.9, big, 0, 0, 0), (0.1, 0, big, big, 0)],
                                   "score double, pos long, neg long, tp_before long, fp_before long")
    monkeypatch.setattr(evaluate, "_score_counts", lambda *a, **k: counts)
    assert tuple(auc(counts).first()) == (1.0, 1.0)


def test_nan_is_filled(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,), (float("nan"),), (None,)], "v double")
    fitted = clean.fit_cleaning(df, sparse=None, zeros=None)
    assert clean.apply_cleaning(df, fitted).filter(F.isnan("v") | F.col("v").isNull()).count() == 0
    assert clean.impute_median(df, ["v"]).filter(F.isnan("v") | F.col("v").isNull()).count() == 0


def test_uneven_embeddings_raise(spark):
    with pytest.raises(ValueError):
        reduce.embedding_columns(spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0],)], "embedding array<double>"))


@pytest.mark.parametrize("block_rows", [7, 4000])
def test_smote_balances_unscaled_rows_with_string_ids(spark, block_rows):
    rows = [(f"C{i}", 1 if i < 20 else 0 if i < 100 else None, float(i * 1000), float(i % 7)) for i in range(103)]
    df = spark.createDataFrame(rows, "uid string, target int, a double, b double")
    out = smote(df, ["a", "b"], "target", block_rows=block_rows)
    assert {r.target: r["count"] for r in out.groupBy("target").count().collect()} == {0: 80, 1: 80, None: 80}


def test_compressed_and_mismatched_logs(spark, tmp_path):
    (tmp_path / "a").mkdir()
    with gzip.open(tmp_path / "a" / "x.csv.gz", "wt") as f:
        f.write("uid|duration\nC1|3.0\n")
    assert [(r.uid, r.duration) for r in read_flows(spark, str(tmp_path / "a")).collect()] == [("C1", 3.0)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "1.csv").write_text("uid|duration\nC1|3.0\n")
    (tmp_path / "b" / "2.csv").write_text("duration|uid\n4.0|C2\n")
    both = {(r.uid, r.duration) for r in read_flows(spark, str(tmp_path / "b")).collect()}
    assert both == {("C1", 3.0), ("C2", 4.0)}
    with pytest.raises(Exception):
        read_flows(spark, str(tmp_path / "b"), mixed_headers=False).collect()


@pytest.mark.parametrize("order", ["interleaved", "reversed"])
def test_late_events_count_in_gap_statistics(spark, tmp_path, order):
    times = [T0 + dt.timedelta(seconds=60 * i) for i in range(20)]
    halves = (times[::2], times[1::2]) if order == "interleaved" else (times[10:], times[:10])
    src = str(tmp_path / "in")
    for n, half in enumerate(halves):
        (spark.createDataFrame([("10.0.0.1", t) for t in half], "ip string, ts timestamp").coalesce(1)
         .write.mode("append").parquet(src))
    s = spark.readStream.schema("ip string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    out = S.run_to_table(S.stream_gap_stats(s.withWatermark("ts", "1 day"), "ip", "ts"), "late", "update", ["key"])
    assert [(r.key, r.rows, r.time_delta_mean, r.time_delta_std) for r in out.collect()] == [("10.0.0.1", 20, 60.0, 0.0)]


def test_label_encode_is_bounded(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("v"))
    assert J.label_encode(df, ["v"])[0].select("v").distinct().count() == 50
    with pytest.raises(ValueError):
        J.label_encode(df, ["v"], max_labels=10)


def test_router_counts_exactly_near_its_limits(spark):
    df = spark.range(1000).select(*[(F.col("id") % n).cast("string").alias(f"c{n}") for n in (9, 10, 99, 100)])
    _, route = J.encode_auto(df, df.columns)
    assert route == {"c9": "one_hot", "c10": "codes", "c99": "codes", "c100": "text"}
