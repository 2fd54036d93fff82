"""Figures that must not outgrow the input: rows computed once, tasks of bounded size, nothing joined twice."""

import math
from collections import Counter
from datetime import datetime, timedelta

import pytest

from flowsift.operators import sample as I
from flowsift.operators import windows as G

DAY = 86_400


def sightings(spark):
    """(id, source, port, time): ties, repeated rows, null sources and ports, ports seen again within and across chunks."""
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [(i, None if i % 11 == 0 else i % 3, None if i % 7 == 0 else (i * i) % 5, at((i * 13) % 200)) for i in range(120)]
    return rows + rows[:9], "id int, source int, port int, at timestamp_ntz"


def test_prefix_windows_join_nothing_and_equal_brute_force(spark):
    rows, schema = sightings(spark)
    df = spark.createDataFrame(rows, schema)
    got = G.source_window_features_prefix(df, "source", "at", "port", DAY, "n", "d", chunk_seconds=DAY / 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # the totals of earlier chunks are deltas of the same stream
    near = lambda r: [x for x in rows if x[1] == r[1] and r[3] - timedelta(days=1) <= x[3] <= r[3]]
    want = Counter((*r[:3], len(near(r)), len({x[2] for x in near(r)} - {None})) for r in rows)
    assert Counter(tuple(r) for r in got.select("id", "source", "port", "n", "d").collect()) == want
    one = G.rolling_count(df, "source", "at", DAY, "n", method="prefix", chunk_seconds=DAY / 5)
    assert Counter((r.id, r.n) for r in one.select("id", "n").collect()) == Counter((r[0], len(near(r))) for r in rows)


def write_events(spark, folder, n=400):
    kinds = ("click", "error", "purchase", "signup", "view")
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=7 * i), i % 9, kinds[i * i % 5], 1.25 + i % 37, f'{{"k": {i % 50}}}')
            for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_modelling_passes_read_the_window_features_once_made(spark, tmp_path, monkeypatch):
    from flowsift.plans import modelling as M
    seen, clean = [], M.clean_flows
    monkeypatch.setattr(M, "clean_flows", lambda df, **more: seen.append(df) or clean(df, **more))
    data, feats = M.prepare_flows(spark, write_events(spark, tmp_path))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan  # a scan and the join of the sources' gaps
    again = I.assign_folds(I.stratified_split(data.drop("split", "fold"), "target", (0.75, 0.25)), "target", 5)
    at = lambda df: {r.uid: (r.split, r.fold) for r in df.select("uid", "split", "fold").collect()}
    assert at(data) == at(again) and data.count() == 400


def test_a_fit_has_more_tasks_when_rows_are_more(spark, tmp_path, monkeypatch):
    from flowsift import session
    from flowsift.operators import models as L
    from flowsift.plans import modelling as M
    monkeypatch.setattr(session, "TASK_BYTES", 50_000)
    data, feats = M.prepare_flows(spark, write_events(spark, tmp_path))
    assert data.rdd.getNumPartitions() == 400 * L.ROW_BYTES // 50_000
    assert max(data.rdd.glom().map(len).collect()) < 60
    parts, forest = [], L.random_forest

    class Seen:
        def __init__(self, *given, **params):
            self.pipe = forest(*given, **params)

        def fit(self, df):
            parts.append(df.rdd.getNumPartitions())
            return self.pipe.fit(df)

    monkeypatch.setattr(L, "random_forest", Seen)
    M.fit_and_score("rf", data, feats, num_trees=20, max_depth=3)
    M.fit_and_score("rf", data, feats, num_trees=200, max_depth=2)
    size = [L.row_bytes("rf", len(feats), num_trees=n) for n in (20, 200)]
    assert parts == [max(4, -(-300 * s // 50_000)) for s in size] and parts[1] > parts[0]


def test_words_of_one_shape_are_hashed_once():
    from flowsift.llm import quality_nbsvm as Q
    kind = lambda c: "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
    words = ["Abba", "Ottokar", "ÄßǅX99-_٣²", "Ⅻa", "\U0001F600z", "\ud800b", *(f"Zz{'y' * (i % 40)}" for i in range(400))]
    for w in words:
        kinds = "".join(map(kind, w))
        assert Q.shape(w) == "".join(c for i, c in enumerate(kinds) if not i or kinds[i - 1] != c)
    Q._TOKENS.clear(), Q._FORMS.clear()
    Q.features(" ".join(f"Zz{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)))
    assert len(Q._TOKENS) == 400 and len(Q._FORMS) == 1


def test_tasks_fill_the_cores(monkeypatch):
    from flowsift import session
    monkeypatch.setattr(session, "TASK_BYTES", 1000)
    assert [session.tasks_for(None, n, 100, least=4) for n in (0, 1, 40, 41, 80, 81)] == [4, 4, 4, 8, 8, 12]


def test_models_are_compared_on_rows_scored_once(spark):
    from flowsift.operators import evaluate as N
    from flowsift.plans import catalog_models as C
    from flowsift.plans.modelling import fit_and_score
    rows = [(f"u{i}", float(i % 7), float(i % 3), int(i % 7 > 3), "test" if i % 4 == 0 else "train") for i in range(200)]
    data = spark.createDataFrame(rows, "uid string, a double, b double, target int, split string").cache()
    params = {"rf": {"num_trees": 3, "max_depth": 3}, "gbt": {"rounds": 2}}
    out = C._compared(data, ["a", "b"], ("rf", "gbt"), **params)
    assert "mllib" not in (plan := out._jdf.queryExecution().analyzed().toString()) and "UDF" not in plan
    want = N.comparison_table({k: fit_and_score(k, data, ["a", "b"], **params[k])[1] for k in params}, "target")
    assert out.orderBy("seq").collect() == want.orderBy("seq").collect()


def test_registered_searches_do_all_twenty_draws(spark, monkeypatch):
    """The registered queries over a table of their own: a trial for each of the reference's 20 draws, all folds fitted."""
    from flowsift.operators import models as L
    from flowsift.operators import search as R
    from flowsift.plans import catalog_models as C
    rows = [(float(i % 7), int(i % 7 > 3), i % 2, "train") for i in range(60)]
    data = spark.createDataFrame(rows, "a double, target int, fold int, split string").cache()
    monkeypatch.setattr(C, "prepare_flows", lambda spark, d: (data, ["a"]))
    for name, query, space in (("forest", C.q_rf_random_search, R.FOREST_SPACE), ("boosting", C.q_gbt_random_search, R.BOOSTING_SPACE)):
        asked = []

        def build(params, features, label, seed=42):
            asked.append(params)
            return L.random_forest(features, label, num_trees=1, max_depth=1, seed=seed)

        build.__name__ = f"tiny-{name}"
        monkeypatch.setattr(R, name, build)
        got = query(spark, "").orderBy("trial").collect()
        assert [r.trial for r in got] == list(range(20)) and all(r.folds == 2 for r in got)
        assert len(asked) == 20 * 2 + 1 and all(d in asked for d in R.draw(space, 20))


def test_network_steps_are_mllibs_over_packed_rows(spark, tmp_path, monkeypatch):
    """Three partitions whose last blocks are not full: loss, gradient and steps as MLlib's, without a fit on all rows."""
    import numpy as np
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler
    from flowsift.operators import epochs as E
    from flowsift.operators import network as W
    rows = [(((i * 37) % 101) / 50 - 1, ((i * 53) % 97) / 48 - 1, int((i * 37) % 101 > 40)) for i in range(700)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame(rows, "a double, b double, target int").repartition(3)).cache()
    layers = [2, 5, 2]
    net = lambda steps: MultilayerPerceptronClassifier(labelCol="target", layers=layers, maxIter=steps, blockSize=16, seed=5)
    want = net(12).fit(df)
    start = net(0).fit(df.limit(1)).weights.toArray()
    monkeypatch.setattr(W, "ROWS_AT_ONCE", 40)  # not a multiple of the block
    data = W.blocks(df, "target", 2, 16)
    f = W.Objective(data, layers, 16)
    assert f.blocks == sum(-(-n // 16) for n in df.rdd.glom().map(len).collect())
    values = []
    got = W.minimise(lambda w: values.append(f(w)[0]) or f(w), start, 12)
    assert np.allclose(got, want.weights.toArray(), rtol=1e-7, atol=1e-9)
    assert abs(f(got)[0] - want.summary().objectiveHistory[-1]) < 1e-9 and f(got)[0] < values[0]
    w, e = got.copy(), 1e-6
    w[3] += e
    assert abs((f(w)[0] - f(got)[0]) / e - f(got)[1][3]) < 1e-4
    loss, accuracy = W.measured(data, got, layers, E.LEAST_PROBABILITY)
    assert np.allclose((loss, accuracy), E.measured(want, df.selectExpr("*", "1 as all"), "target", "all")[1], atol=1e-7)

    seen, fit = [], MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    table = df.drop("features")
    E.train_network(table, table.limit(90), ["a", "b"], hidden=(5,), epochs=2, steps=2, ledger=str(tmp_path))
    assert seen and max(seen) == 1

    nan = table.limit(5).selectExpr("double('NaN') as a", "b", "target").union(table)
    bare = table.limit(5).selectExpr("a", "b", "int(null) as target").union(table)
    for broken in (nan, bare):  # a fit does not learn from what is no number
        with pytest.raises(Exception, match="finite|NaN|Null"):
            E.train_network(broken, table, ["a", "b"], hidden=(5,), epochs=1, steps=1, ledger=str(tmp_path))
    one = lambda held: E.train_network(table, held, ["a", "b"], hidden=(5,), epochs=1, steps=1, ledger=str(tmp_path)).history.first()
    assert math.isnan(one(nan).val_loss)  # more partitions, other blocks: the weights are not the same to the digit
    assert abs(one(bare).val_loss - one(table).val_loss) < 1e-3 and one(bare).val_accuracy == one(table).val_accuracy


def test_node_statistics_of_all_tasks_fit_an_executor(spark, monkeypatch):
    """A deep forest fills what it is given in every task: two tasks of 1,024 MB do not fit 1,800 MB."""
    from flowsift.operators import models as L
    managed, tasks = L.executor_memory()
    assert managed > 0 and tasks == 4
    given = lambda: L.random_forest(["a"]).getStages()[-1].getMaxMemoryInMB()
    for (mb, cores), want in {(900, 2): 225, (100, 4): 32, (64_000, 2): 1024}.items():
        monkeypatch.setattr(L, "executor_memory", lambda: (mb << 20, cores))
        assert given() == want
