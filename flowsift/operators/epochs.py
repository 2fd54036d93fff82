"""Training the network epoch by epoch (L4, L7): warm starts, a validation curve,
early stopping, and resumption.

Each epoch goes on from the weights of the one before, for some L-BFGS steps over
the training rows. Loss and accuracy of both splits are measured in one pass and
recorded in the ledger with the weights, so that a training started again goes on
after the last whole epoch. The best epoch is the one of the
least validation loss; training stops when ``patience`` epochs brought no better.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.ledger import Ledger, fingerprint
from flowsift.operators import network as W
from flowsift.operators.models import row_bytes
from flowsift.session import cut_lineage, merged, scratch_path, tasks_for

LEAST_PROBABILITY = 1e-15


def measured(model, rows: DataFrame, label: str, by: str) -> dict:
    """{value of ``by``: (mean log loss, accuracy) of a model's predictions there}."""
    p = vector_to_array("probability")[F.col(label).cast("int")]
    hit = (F.col("prediction") == F.col(label)).cast("double")
    got = model.transform(rows).groupBy(by).agg(
        F.avg(-F.log(F.greatest(p, F.lit(LEAST_PROBABILITY)))).alias("loss"), F.avg(hit).alias("accuracy")).collect()
    return {r[0]: (float(r.loss), float(r.accuracy)) for r in got}


class Training:
    """model: the best epoch's; history: (epoch, train_loss, train_accuracy, val_loss, val_accuracy, best)."""

    def __init__(self, model: PipelineModel, history: DataFrame, ran: int):
        self.model, self.history, self.ran = model, history, ran


def train_network(train: DataFrame, validation: DataFrame, features: Sequence[str], label: str = "target",
                  hidden: Sequence[int] = (128, 64, 32), epochs: int = 50, steps: int = 2, patience: int = 10,
                  least_gain: float = 1e-4, seed: int = 42, block_size: int = 128, ledger: str | None = None) -> Training:
    """Train at most ``epochs`` epochs (those of the ledger among them); ``ran`` counts the ones done now."""
    spark = train.sparkSession
    vector = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    both = [vector.transform(x).select("features", label, F.lit(held).alias("held"))
            for x, held in ((train, False), (validation, True))]
    both = both[0].unionByName(both[1])
    rows = cut_lineage(merged(both, tasks_for(spark, both.count(), row_bytes("mlp", len(features)))))
    learned = rows.filter(~F.col("held"))
    layers = [len(features), *hidden, 2]
    book = Ledger(spark, ledger or scratch_path(spark, "epochs"), {
        "layers": layers, "steps": steps, "seed": seed, "block": block_size, "features": list(features), "label": label,
        "rows": fingerprint(rows.select(vector_to_array("features").alias("x"), label, "held"))})
    done, ran = book.done(), 0
    past: list[dict] = []
    while f"epoch-{len(past)}" in done:
        past.append(done[f"epoch-{len(past)}"])

    def network(steps: int, start) -> MultilayerPerceptronClassifier:
        net = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=layers, maxIter=steps,
                                             blockSize=block_size, seed=seed, solver="l-bfgs")
        return net if start is None else net.setInitialWeights(Vectors.dense(start))

    def best() -> int:
        top = 0
        for e, row in enumerate(past):
            if row["val_loss"] < past[top]["val_loss"] - least_gain:
                top = e
        return top

    held = W.blocks(rows.filter("held"), label, len(features), block_size, "held", learned=False)
    shown = W.blocks(learned, label, len(features), block_size)
    objective = W.Objective(shown, layers, block_size)
    while len(past) < epochs and (not past or len(past) - 1 - best() < patience):
        start = past[-1]["weights"] if past else network(0, None).fit(learned.limit(1)).weights.toArray()
        weights = W.minimise(objective, np.array(start, dtype=float), steps)
        (tl, ta), (vl, va) = (W.measured(x, weights, layers, LEAST_PROBABILITY) for x in (shown, held))
        past.append({"train_loss": tl, "train_accuracy": ta, "val_loss": vl, "val_accuracy": va, "weights": weights.tolist()})
        book.record(f"epoch-{len(past) - 1}", past[-1])
        ran += 1
    top = best()
    history = spark.createDataFrame(
        [(e + 1, r["train_loss"], r["train_accuracy"], r["val_loss"], r["val_accuracy"], e == top) for e, r in enumerate(past)],
        "epoch int, train_loss double, train_accuracy double, val_loss double, val_accuracy double, best boolean")
    model = network(0, past[top]["weights"]).fit(learned.limit(1))  # no step: the weights as they are
    return Training(PipelineModel([vector, model]), history, ran)
