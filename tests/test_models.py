"""Model tests: quality floor on separable data, save/load equality,
importance sums, evaluation helpers on fitted models."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowsift.operators import evaluate as N
from flowsift.operators import models as L
from flowsift.operators import reduce as K
from flowsift.plans.modelling import fit_and_score, prepare_flows
from flowsift.session import cut_lineage
from flowsift.sources import logs
from flowsift.sources.views import read_table


@pytest.fixture(scope="module")
def prepared(spark):
    return prepare_flows(spark, SF_SMALL)


@pytest.mark.parametrize("kind,params", [("rf", {"num_trees": 20, "max_depth": 10}),
                                         ("gbt", {"rounds": 10}),
                                         ("svm", {"dim": 64}),
                                         ("mlp", {"hidden": (16, 8), "max_iter": 30})])
def test_quality_floor(spark, prepared, kind, params):
    data, feats = prepared
    model, scored = fit_and_score(kind, data, feats, **params)
    m = N.binary_metrics(scored, "target").first()
    # the connection state alone decides the class in the test view; the trees
    # and the network must find it. The RBF machine weighs all 19 standardised
    # inputs equally, so 18 noise dimensions blur its one signal: it only has
    # to beat the majority class (60 %).
    floor = 0.65 if kind == "svm" else 0.9
    assert m["accuracy"] >= floor, (kind, m)
    assert scored.filter((F.col("score") < 0) | (F.col("score") > 1)).count() == 0


def test_save_load_same_predictions(spark, prepared):
    data, feats = prepared
    model, scored = fit_and_score("rf", data, feats, num_trees=10, max_depth=6)
    path = tempfile.mkdtemp(prefix="flowsift-model-", dir="/tmp") + "/rf"
    logs.save_model(model, path)
    again = L.score(logs.load_model(path), data.filter("split = 'test'"), "target", keep=("uid",))
    a = {r["uid"]: (r["prediction"], round(r["score"], 12)) for r in scored.collect()}
    b = {r["uid"]: (r["prediction"], round(r["score"], 12)) for r in again.collect()}
    assert a == b


def test_importance_sums_to_one(spark, prepared):
    data, feats = prepared
    model, _ = fit_and_score("rf", data, feats, num_trees=10, max_depth=6)
    imp = L.feature_importance(model, feats).collect()
    assert abs(sum(r["importance"] for r in imp) - 1.0) < 1e-9 and len(imp) == len(feats)


def test_svm_rff_approximates_kernel(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    X = rng.normal(size=(50, 5))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(X)], "id long, f array<double>")
    from pyspark.ml.functions import array_to_vector, vector_to_array
    ff = L.FourierFeatures("v", "z", gamma=0.2, dim=4096, nIn=5, seed=1)
    Z = np.array([r[0] for r in ff.transform(df.withColumn("v", array_to_vector("f")))
                  .select(vector_to_array("z")).orderBy(F.col("id")).collect()])
    Zs = np.array([r[0] for r in ff.transform(df.withColumn("v", array_to_vector("f")).orderBy("id"))
                   .select(vector_to_array("z")).collect()])
    K_true = np.exp(-0.2 * ((X[:, None] - X[None]) ** 2).sum(-1))
    assert np.abs(Zs @ Zs.T - K_true).max() < 0.1
    assert Z.shape == (50, 4096)


def test_pca_explained_and_signs(spark):
    emb = read_table(spark, SF_SMALL, "embeddings")
    wide, cols = K.embedding_columns(emb, "embedding")
    res = K.pca(wide, cols[:10], 2)
    assert 0 < res.explained[1] <= res.explained[0] <= 1
    import numpy as np
    for j in range(2):
        assert res.loadings[np.abs(res.loadings[:, j]).argmax(), j] > 0


def small_problem(spark, n=240):
    import numpy as np
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, n)
    rows = [(int(t), float(t + rng.normal(0, .3)), float(rng.normal()), float(t * .5 + rng.normal()), int(i % 5))
            for i, t in enumerate(y)]
    return spark.createDataFrame(rows, "target int, good double, noise double, weak double, fold int").repartition(2)


def test_draws_stay_in_their_ranges(spark):
    from flowsift.operators import search as R
    for space in (R.FOREST_SPACE, R.BOOSTING_SPACE):
        trials = R.draw(space, 300, 1)
        assert trials == R.draw(space, 300, 1) and trials != R.draw(space, 300, 2)
        for name, kind in space.items():
            values = {t[name] for t in trials}
            if isinstance(kind, list):
                assert values == set(kind)
            elif kind[0] == "int":
                assert min(values) >= kind[1] and max(values) < kind[2] and len(values) > min(4, kind[2] - kind[1] - 1)
            else:
                assert min(values) >= kind[1] and max(values) <= kind[1] + kind[2]
    params = dict(R.FOREST_SPACE, n_estimators=50, max_depth=None, min_samples_split=9, min_samples_leaf=2,
                  max_features=None, bootstrap=False, class_weight="balanced")
    rf = R.forest(params, ["a"], "y").getStages()[-1]
    assert (rf.getMaxDepth(), rf.getMinInstancesPerNode(), rf.getFeatureSubsetStrategy(), rf.getWeightCol()) == (30, 5, "all", "weight")
    gbt = R.boosting(R.draw(R.BOOSTING_SPACE, 1)[0], ["a"], "y").getStages()[-1]
    assert 50 <= gbt.getMaxIter() < 300 and gbt.getMinInfoGain() >= 0 and 0.7 <= float(gbt.getFeatureSubsetStrategy()) <= 1


def test_search_continues_from_its_ledger(spark, tmp_path, monkeypatch):
    from flowsift.operators import search as R
    data, features, fits = small_problem(spark), ["good", "noise"], []
    space = {"depth": ("int", 1, 4), "rounds": [2, 3], "step": ("uniform", 0.1, 0.2)}

    def build(params, features, label, seed=42):
        fits.append(params)
        if len(fits) == stop:
            raise RuntimeError("lost")
        return L.gradient_boosting(features, label, rounds=params["rounds"], max_depth=params["depth"], seed=seed)

    stop = 8
    with pytest.raises(RuntimeError):
        R.random_search(data, features, space, build, draws=3, parallelism=1, ledger=str(tmp_path))
    stop = -1
    fits.clear()
    found = R.random_search(data, features, space, build, draws=3, parallelism=2, ledger=str(tmp_path))
    assert 15 - 8 + 1 <= len(fits) <= 15 - 7 + 1  # what was missing, and the best one on all rows
    rows = found.trials.orderBy("trial").collect()
    assert len(rows) == 3 and all(r.folds == 5 for r in rows) and sum(r.best for r in rows) == 1
    assert max(r.mean_f1 for r in rows) == next(r.mean_f1 for r in rows if r.best) > 0.85
    fits.clear()
    again = R.random_search(data, features, space, build, draws=3, ledger=str(tmp_path))
    assert len(fits) == 1 and again.trials.collect() == found.trials.collect()
    R.random_search(data, features, space, build, draws=4, ledger=str(tmp_path))  # one draw more, and the refit
    assert len(fits) == 1 + 5 + 1
    R.random_search(data.filter("good < 1.2"), features, space, build, draws=1, ledger=str(tmp_path))  # other rows
    assert len(fits) == 7 + 5 + 1


def test_elimination_paths_do_not_see_their_held_out_fold(spark, tmp_path):
    """A feature that tells the label in fold 0 only: the path that holds fold 0 out must not favour it."""
    df = cut_lineage(small_problem(spark).withColumn("leak", F.when(F.col("fold") == 0, F.col("target")).otherwise(F.rand(3))))
    got = K.rfecv(df, ["good", "noise", "weak", "leak"], num_trees=20, max_depth=6, ledger=str(tmp_path))
    assert [n for n, _ in got.history] == [4, 3, 2, 1] and len(got.paths) == 5
    assert all([len(x["features"]) for x in p] == [4, 3, 2, 1] for p in got.paths.values())
    assert got.paths[0][-1]["features"] == ["good"] and "good" in got.chosen
    assert "leak" not in got.paths[0][2]["features"] or got.paths[0][0]["order"].index("leak") < 3
    assert got.history == K.rfecv(df, ["good", "noise", "weak", "leak"], num_trees=20, max_depth=6,
                                  ledger=str(tmp_path)).history


def test_network_training_resumes_and_keeps_its_best_epoch(spark, tmp_path):
    from flowsift.operators import epochs as E
    data = small_problem(spark, 300)
    train, held = data.filter("fold > 0"), data.filter("fold = 0")

    def run(n, **more):
        return E.train_network(train, held, ["good", "weak"], hidden=(6,), epochs=n, steps=3, ledger=str(tmp_path), **more)

    first = run(3, patience=50)
    then = run(7, patience=50)
    rows = then.history.collect()
    assert first.ran == 3 and then.ran == 4 and [r.epoch for r in rows] == list(range(1, 8))
    assert [tuple(r)[:5] for r in rows[:3]] == [tuple(r)[:5] for r in first.history.collect()]
    assert rows[-1].train_loss < rows[0].train_loss and sum(r.best for r in rows) == 1
    best = next(r for r in rows if r.best)
    marked = then.model.stages[0].transform(held).withColumn("all", F.lit(1))
    loss, accuracy = E.measured(then.model.stages[-1], marked, "target", "all")[1]
    assert abs(loss - best.val_loss) < 1e-9 and accuracy == best.val_accuracy > 0.85
    assert run(7, patience=50).ran == 0
    stopped = run(200, patience=2, least_gain=0.5)  # no epoch gains that much: it stops at once
    assert stopped.ran == 0 and len(stopped.history.collect()) == 7


def test_write_and_load_dataset(spark, prepared):
    data, feats = prepared
    path = tempfile.mkdtemp(prefix="flowsift-ds-", dir="/tmp")
    logs.write_dataset(data.filter("split = 'train'").drop("split"), data.filter("split = 'test'").drop("split"),
                       path, feats, "target")
    train, test, names, label, share = logs.load_dataset(spark, path)
    assert names == feats and label == "target"
    assert train.count() + test.count() == data.count()
    assert {r["split"] for r in share.collect()} == {"train", "test"}
    assert os.path.isdir(path + "/data/split=train")


def test_end_to_end_run(spark):
    from flowsift.plans.end_to_end import run
    out = tempfile.mkdtemp(prefix="flowsift-run-", dir="/tmp")
    res = run(spark, SF_SMALL, out, kinds=("rf", "gbt"),
              params={"rf": {"num_trees": 10, "max_depth": 8}, "gbt": {"rounds": 5}})
    assert {r["model"] for r in res["comparison"]} == {"rf", "gbt"}
    assert {r["metric"] for r in res["recommendation"]} == {"f1", "accuracy"}
    assert spark.read.parquet(out + "/cleaned").count() == 1000
    assert os.path.isdir(out + "/models/rf") and os.path.isdir(out + "/dataset/data")


def test_pca_matches_numpy(spark):
    import numpy as np
    from flowsift.plans.catalog_core import raw
    from flowsift.plans.catalog_models import PCA_FLOW_COLUMNS
    r = raw(spark, SF_SMALL)
    cols = list(PCA_FLOW_COLUMNS)
    res = K.pca(r, cols, 2, keep=("uid",))
    X = np.array([[row[c] if row[c] is not None else 0.0 for c in cols]
                  for row in r.select("uid", *cols).orderBy("uid").collect()], dtype=float)
    Z = (X - X.mean(0)) / X.std(0)
    w, V = np.linalg.eigh(np.cov(Z, rowvar=False))
    order = np.argsort(w)[::-1]
    assert np.allclose(res.explained, (w[order] / w.sum())[:2], atol=1e-9)
    proj = np.array([[row["pc1"], row["pc2"]] for row in res.projected.orderBy("uid").collect()])
    for j in range(2):
        v = V[:, order[j]]
        v = v * np.sign(v[np.abs(v).argmax()])
        assert np.allclose(proj[:, j], Z @ v, atol=1e-6)
