"""Property tests: results that must hold on any data and any partitioning."""

import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from flowsift.operators import encode as J
from flowsift.operators import evaluate as N
from flowsift.operators import sample as I
from flowsift.operators import stats as S
from flowsift.operators import windows as G
from flowsift.plans.catalog_core import labeled
from flowsift.plans.catalog_prep import scored
from flowsift.sources.views import flows, read_table


def test_stratified_split_exact_and_partition_free(spark):
    df = labeled(spark, SF_MID)
    a = I.stratified_split(df, "label", (0.7, 0.15, 0.15), ("train", "validation", "test"))
    b = I.stratified_split(df.repartition(13), "label", (0.7, 0.15, 0.15), ("train", "validation", "test"),
                           hex_digits=2)
    ka = {(r["uid"], r["split"]) for r in a.select("uid", "split").collect()}
    kb = {(r["uid"], r["split"]) for r in b.select("uid", "split").collect()}
    assert ka == kb and len(ka) == df.count()
    counts = {(r["label"], r["split"]): r["count"] for r in a.groupBy("label", "split").count().collect()}
    sizes = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    for lab, n in sizes.items():
        assert abs(counts[(lab, "train")] - 0.7 * n) <= 1
        assert abs(counts.get((lab, "validation"), 0) - 0.15 * n) <= 1


def test_folds_balanced(spark):
    f = I.assign_folds(labeled(spark, SF_MID), "label", 5)
    per = f.groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r["spread"] <= 1 for r in per)


def test_sample_n_size(spark):
    df = flows(spark, SF_SMALL)
    assert I.sample_n(df, 50, "uid").count() == 50
    assert I.sample_n(df, 10 ** 6, "uid").count() == df.count()


@pytest.mark.parametrize("chunk_days", [5, 31, 400])
def test_chunked_windows_equal_brute_force(spark, chunk_days):
    li = read_table(spark, SF_SMALL, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate")
    got = G.source_window_features(li, "l_suppkey", "l_shipdate", "l_partkey", 30 * 86400, "n", "d",
                                   chunk_seconds=chunk_days * 86400)
    t = G.micros("l_shipdate")
    w = Window.partitionBy("l_suppkey").orderBy("_t").rangeBetween(-30 * 86400 * 10 ** 6, 0)
    ref = (li.withColumn("_t", t).withColumn("n", F.count(F.lit(1)).over(w))
           .withColumn("d", F.size(F.collect_set("l_partkey").over(w))))
    key = ["l_orderkey", "l_linenumber"]
    a = {tuple(r) for r in got.select(*key, "n", "d").collect()}
    b = {tuple(r) for r in ref.select(*key, "n", "d").collect()}
    assert a == b


def test_scaler_population(spark):
    df = read_table(spark, SF_SMALL, "orders").select("o_totalprice")
    sc = J.fit_scaler(df, ["o_totalprice"])
    out = J.apply_scaler(df, sc).agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s")).first()
    assert abs(out["m"]) < 1e-9 and abs(out["s"] - 1) < 1e-9


def test_roc_monotone_and_auc_matches_mllib(spark):
    s = scored(spark, SF_MID)
    pts = [(r["fpr"], r["tpr"]) for r in N.roc_curve(s).orderBy(F.desc("threshold")).collect()]
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)
    assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(pts, pts[1:]))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    a = N.auc(s).first()
    mllib = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC",
                                          numBins=0).evaluate(s.withColumn("label", F.col("label").cast("double")))
    assert math.isclose(area, a["auc_trapezoid"], abs_tol=1e-12)
    assert math.isclose(mllib, a["auc_trapezoid"], abs_tol=1e-9)
    assert a["auc_rank"] <= a["auc_trapezoid"]


def test_kde_close_to_numpy(spark):
    df = read_table(spark, SF_SMALL, "orders").select("o_totalprice", "o_orderstatus")
    got = S.kde(df, "o_totalprice", by="o_orderstatus", grid=50).filter("o_orderstatus = 'F'").orderBy("x").collect()
    v = np.log10(np.array([r[0] for r in df.filter("o_orderstatus = 'F'").select("o_totalprice").collect()]))
    h = v.std(ddof=1) * len(v) ** (-0.2)
    xs = np.array([r["x"] for r in got])
    ref = np.exp(-0.5 * ((xs[:, None] - v[None, :]) / h) ** 2).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))
    dens = np.array([r["density"] for r in got])
    assert np.max(np.abs(dens - ref)) < 1e-3 * ref.max()
    assert abs(np.trapezoid(dens, xs) - 1) < 0.01


def test_smote_points_on_segments(spark):
    from flowsift.operators.smote import smote
    from flowsift.operators.reduce import embedding_columns
    emb = read_table(spark, SF_SMALL, "embeddings")
    wide, cols = embedding_columns(emb, "embedding")
    x = wide.withColumn("target", (F.col("label") < 2).cast("int")).withColumn("uid", F.col("vec_id"))
    out = smote(x, cols[:8], "target", "uid", k=3)
    counts = {r["target"]: r["count"] for r in out.groupBy("target").count().collect()}
    assert counts[0] == counts[1]
    orig = np.array([[r[c] for c in cols[:8]] for r in out.filter("synthetic = 0 AND target = 1").collect()])
    syn = np.array([[r[c] for c in cols[:8]] for r in out.filter("synthetic = 1").collect()])
    assert len(syn) > 0
    # brute force: every synthetic point lies on a segment between a minority row and one of its 3 nearest
    d2 = ((orig[:, None, :] - orig[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    nn = np.argsort(d2, axis=1)[:, :3]
    for s in syn:
        ok = False
        for i in range(len(orig)):
            for j in nn[i]:
                seg = orig[j] - orig[i]
                lam = float(np.dot(s - orig[i], seg) / max(np.dot(seg, seg), 1e-300))
                if -1e-9 <= lam <= 1 + 1e-9 and np.allclose(orig[i] + lam * seg, s, atol=1e-6):
                    ok = True
                    break
            if ok:
                break
        assert ok


def test_smote_blocks_with_duplicates(spark):
    from flowsift.operators.smote import smote
    rows = [(i, 1 if i < 6 else 0, float(i % 3), float(i % 3)) for i in range(20)]  # minority has duplicates
    df = spark.createDataFrame(rows, "uid long, target int, a double, b double")
    out = smote(df, ["a", "b"], "target", "uid", k=2, block_rows=4)
    counts = {r["target"]: r["count"] for r in out.groupBy("target").count().collect()}
    assert counts[0] == counts[1] == 14
    pts = {(r["a"], r["b"]) for r in out.filter("synthetic = 1").collect()}
    assert all(0 <= a <= 2 and abs(a - b) < 1e-12 for a, b in pts)


def brute_neighbours(ids, x, k):
    """{id: [(squared distance, id)]}; ids ascending."""
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return {i: [(d[n, m], ids[m]) for m in np.argsort(d[n], kind="stable")[:k] if m != n] for n, i in enumerate(ids)}


@pytest.mark.parametrize("cell_rows, block_rows, asking", [(10, 4, 7), (50, 4000, 20_000), (1000, 4000, 20_000), (1000, 23, 50)])
def test_neighbours_equal_brute_force_over_many_cells(spark, monkeypatch, cell_rows, block_rows, asking):
    from flowsift.operators import knn
    monkeypatch.setattr(knn, "ASKING_ROWS", asking)
    rng = np.random.default_rng(cell_rows)
    x = np.concatenate([rng.normal(size=(120, 6)), 50 + 0.1 * rng.normal(size=(60, 6)), np.full((20, 6), 3.0),
                        rng.integers(0, 2, (40, 6)).astype(float), 1e6 + rng.normal(size=(10, 6))])
    ids = [f"r{i:03}" for i in range(len(x))]
    rows = [*zip(ids, x.tolist()), ("bad", [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("nan", [float("nan")] * 6), ("inf", [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "uid string, v array<double>").withColumn("x", F.lit(0)).withColumn("cell", F.lit(1))
    got = {r.uid: [(n.d, n.id) for n in r.near] for r in knn.nearest_neighbours(
        df, "uid", "v", 5, cell_rows, block_rows).collect()}
    assert got == brute_neighbours(ids, x, 5)


def test_neighbours_within_classes(spark):
    from flowsift.operators.knn import nearest_neighbours
    rng = np.random.default_rng(8)
    x, cls = rng.normal(size=(150, 4)), rng.choice(["a", "b", "c"], 150)
    df = spark.createDataFrame([(i, v.tolist(), None if c == "c" else str(c)) for i, (v, c) in enumerate(zip(x, cls))],
                               "uid long, v array<double>, y string")
    got = {r.uid: [(n.d, n.id) for n in r.near] for r in nearest_neighbours(df, "uid", "v", 3, 9, 5, within="y").collect()}
    want = {}
    for c in "abc":
        at = np.flatnonzero(cls == c)
        want |= brute_neighbours(at.tolist(), x[at], 3)
    assert got == want


def test_neighbours_of_few_rows(spark):
    from flowsift.operators.knn import nearest_neighbours
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [1.0])], "uid long, v array<double>")
    got = {r.uid: [n.id for n in r.near] for r in nearest_neighbours(df, "uid", "v", 5).collect()}
    assert got == {1: [2, 3], 2: [3, 1], 3: [2, 1]}
    assert nearest_neighbours(df.limit(0), "uid", "v", 5).count() == 0
    assert [r.near for r in nearest_neighbours(df.limit(1), "uid", "v", 5).collect()] == [[]]


def test_neighbour_search_prunes_clustered_rows(spark):
    """Of clustered rows far fewer distances are computed than pairs, and the share falls with the size."""
    from flowsift.operators.knn import nearest_neighbours
    rng = np.random.default_rng(3)
    share = []
    for n in (2_000, 8_000):
        x = np.repeat(rng.uniform(0, 100, (n // 100, 8)), 100, axis=0) + rng.normal(size=(n, 8))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "uid long, v array<double>")
        got = nearest_neighbours(df, "uid", "v", 5, cell_rows=100).agg(F.sum("compared"), F.count("*")).first()
        assert got[1] == n
        share.append(got[0] / (n * (n - 1)))
    assert share[0] < 0.25 and share[1] < share[0] / 2


def test_auc_trapezoid_is_rank_plus_half_ties(spark):
    s = scored(spark, SF_MID)
    a = N.auc(s).first()
    per = s.groupBy("score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).collect()
    P = sum(r["pos"] for r in per)
    Q = sum(r["neg"] for r in per)
    ties = sum(r["pos"] * r["neg"] for r in per) / (P * Q)
    assert math.isclose(a["auc_trapezoid"], a["auc_rank"] + 0.5 * ties, abs_tol=1e-12)


@pytest.mark.parametrize("chunk_days", [0.5, 3, 40])
def test_prefix_windows_equal_brute_force(spark, chunk_days):
    li = read_table(spark, SF_SMALL, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate")
    got = G.source_window_features_prefix(li, "l_suppkey", "l_shipdate", "l_partkey", 30 * 86400, "n", "d",
                                          chunk_seconds=chunk_days * 86400)
    t = G.micros("l_shipdate")
    w = Window.partitionBy("l_suppkey").orderBy("_t").rangeBetween(-30 * 86400 * 10 ** 6, 0)
    ref = (li.withColumn("_t", t).withColumn("n", F.count(F.lit(1)).over(w))
           .withColumn("d", F.size(F.collect_set("l_partkey").over(w))))
    from collections import Counter
    key = ["l_orderkey", "l_linenumber"]
    a = Counter(tuple(r) for r in got.select(*key, "n", "d").collect())
    b = Counter(tuple(r) for r in ref.select(*key, "n", "d").collect())
    assert a == b and sum(a.values()) == li.count()


def test_auto_switches_to_prefix_for_dense_sources(spark):
    li = read_table(spark, SF_SMALL, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate")
    dens = G.densest_window(li, "l_suppkey", "l_shipdate", 30 * 86400)
    assert dens > 1
    # a budget below the densest window forces the prefix form; results must not change
    a = G.source_window_features(li, "l_suppkey", "l_shipdate", "l_partkey", 30 * 86400, "n", "d",
                                 max_task_rows=dens)
    b = G.source_window_features(li, "l_suppkey", "l_shipdate", "l_partkey", 30 * 86400, "n", "d", method="halo")
    from collections import Counter
    key = ["l_orderkey", "l_linenumber", "n", "d"]
    assert Counter(tuple(r) for r in a.select(*key).collect()) == Counter(tuple(r) for r in b.select(*key).collect())


def test_rolling_count_prefix_equals_halo(spark):
    li = read_table(spark, SF_SMALL, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    a = G.rolling_count(li, "l_suppkey", "l_shipdate", 7 * 86400, "n", method="prefix", chunk_seconds=86400)
    b = G.rolling_count(li, "l_suppkey", "l_shipdate", 7 * 86400, "n", method="halo")
    from collections import Counter
    key = ["l_orderkey", "l_linenumber", "n"]
    assert Counter(tuple(r) for r in a.select(*key).collect()) == Counter(tuple(r) for r in b.select(*key).collect())


@pytest.mark.parametrize("d", [5, 60])
def test_pairwise_complete_correlations_equal_numpy(spark, d):
    from flowsift.operators import stats
    rng = np.random.default_rng(d)
    x = rng.normal(size=(300, d)) @ rng.normal(size=(d, d)) + 1e4
    x[:, 1] = 7.0                                  # constant
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 2], x[:150, 3], x[150:, 4] = np.nan, np.nan, np.nan  # empty; two that never meet
    names = [f"c{i}" for i in range(d)]
    df = spark.createDataFrame([tuple(None if i % 2 and np.isnan(v) else float(v) for i, v in enumerate(r)) for r in x],
                               ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(r.a, r.b): r.r for r in stats.correlation_matrix(df, names).collect()}
    assert len(got) == d * d
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            u, v = x[both, i], x[both, j]
            if both.sum() < 2 or u.std() < 1e-9 or v.std() < 1e-9:
                assert got[a, b] is None
            else:
                assert abs(got[a, b] - np.corrcoef(u, v)[0, 1]) < 1e-9


def test_stored_sketches_scan_new_files_only(spark, tmp_path):
    from flowsift.operators import sketches as K
    from flowsift.operators.profile import cardinality
    rng = np.random.default_rng(2)
    rows = [(f"f{i % 4}", float(v), None if i % 9 == 0 else f"t{i % 700}", None) for i, v in enumerate(rng.normal(size=8000))]
    df = spark.createDataFrame(rows, "source_file string, x double, t string, n double")
    read = []

    def of(files):
        read.append(sorted(files))
        return df.filter(F.col("source_file").isin(files))

    store = str(tmp_path / "store")
    assert K.update_store(spark, store, ["f0", "f1"], of) == ["f0", "f1"]
    assert K.update_store(spark, store, ["f0", "f1", "f2", "f3"], of) == ["f2", "f3"]
    assert K.update_store(spark, store, ["f3"], of) == [] and read == [["f0", "f1"], ["f2", "f3"]]
    got = {r.column: r for r in K.merged_profile(spark.read.parquet(store)).collect()}
    x = np.array([r[1] for r in rows])
    assert got["x"].rows == 8000 and got["x"].files == 4 and got["x"].min == x.min() and got["x"].max == x.max()
    for p, v in ((0.25, got["x"].q25), (0.5, got["x"].q50), (0.75, got["x"].q75)):
        assert abs((x <= v).mean() - p) < 0.02
    assert abs(got["x"].n_distinct - 8000) < 400 and abs(got["t"].n_distinct - 700) < 35
    assert got["t"].missing == sum(r[2] is None for r in rows) and got["t"].q50 is None
    assert got["n"].missing == 8000 and got["n"].n_distinct == 0 and got["n"].q50 is None
    exact = {r["column"]: r["n_distinct"] for r in cardinality(df).collect()}
    assert exact == {"source_file": 4, "x": len(set(x)), "t": len({r[2] for r in rows if r[2]}), "n": 0}


def test_many_small_logs_of_several_headers(spark, tmp_path):
    import gzip
    from flowsift.sources.logs import read_flows
    for i in range(120):
        text = ["uid|duration|id.orig_h\nC{0}|{0}.5|h\n", "id.orig_h|uid|duration\nh|C{0}|-\n", "uid|proto\nC{0}|tcp\n"][i % 3].format(i)
        if i % 5:
            (tmp_path / f"{i}.log").write_text(text)
        else:
            with gzip.open(tmp_path / f"{i}.log.gz", "wt") as f:
                f.write(text)
    rows = read_flows(spark, str(tmp_path)).collect()
    assert {r.uid for r in rows} == {f"C{i}" for i in range(120)} and len(rows) == 120
    assert all((r.duration == int(r.uid[1:]) + .5) == (int(r.uid[1:]) % 3 == 0) for r in rows)
    assert {r.proto for r in rows} == {None, "tcp"} and len({r.source_file for r in rows}) == 120
