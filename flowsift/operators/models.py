"""Classifiers as Spark MLlib jobs.

Parity with the reference is by quality, not by bits: MLlib's GBT is not
XGBoost (no second-order gain, no L1/L2 leaf penalties), the RBF-kernel SVM
is approximated by random Fourier features + a linear SVM with Platt
scaling, and the network is MLlib's sigmoid MLP trained with L-BFGS.
Every fit is distributed (tree statistics and gradients are aggregated on
the executors); only parameters and fitted models live on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark's tree depth limit; the reference's "unlimited" depth maps to it
MAX_TREE_DEPTH = 30
# a row of the modelling table in memory, at most
ROW_BYTES = 2500
# the statistics of the nodes that a task splits in one pass, at most
NODE_STATS_MB = 1024


def row_bytes(kind: str, features: int, num_trees: int = 100, dim: int = 256, **_) -> int:
    """About the bytes of a training row as a classifier keeps it between its passes: binned
    values, the row's weight and node in every tree (rf); binned values and the
    prediction (gbt); the Fourier features (svm); the scaled values (mlp)."""
    sizes = {"rf": 4 * features + 8 * num_trees + 200, "gbt": 4 * features + 300, "svm": 8 * dim + 200,
             "mlp": 8 * features + 200}
    if kind not in sizes:
        raise ValueError(kind)
    return sizes[kind]


def executor_memory() -> tuple[int, int]:
    """(bytes that Spark manages in the smallest executor, tasks that an executor runs at the same time)."""
    sc = SparkContext.getOrCreate()  # searches ask from threads of their own
    status = sc._jsc.sc().getExecutorMemoryStatus()
    most = [status.apply(k)._1() for k in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(status.keySet())]
    executors = max(len(most) - 1, 1)  # the driver is one of them; in local mode the only one
    return int(min(most)), max(-(-sc.defaultParallelism // executors), 1)


def node_stats_mb() -> int:
    """MB of node statistics for a task: half of its share of an executor, as a deep forest fills
    whatever it is given, in every task at the same time."""
    managed, tasks = executor_memory()
    return max(min(NODE_STATS_MB, managed // (2 * tasks) >> 20), 32)


def _assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


# L1
def random_forest(features: Sequence[str], label: str = "target", weight: str | None = None,
                  num_trees: int = 100, max_depth: int = MAX_TREE_DEPTH, min_leaf: int = 1,
                  subset: str = "sqrt", bootstrap: bool = True, seed: int = 42) -> Pipeline:
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=num_trees, maxDepth=max_depth,
                                minInstancesPerNode=min_leaf, featureSubsetStrategy=subset, bootstrap=bootstrap,
                                impurity="gini", seed=seed, maxBins=64, cacheNodeIds=True,
                                maxMemoryInMB=node_stats_mb(), checkpointInterval=10)
    if weight:
        rf.setWeightCol(weight)
    return Pipeline(stages=[_assembler(features), rf])


# L2
def gradient_boosting(features: Sequence[str], label: str = "target", weight: str | None = None,
                      rounds: int = 100, step: float = 0.1, max_depth: int = 5, subsample: float = 1.0,
                      subset: str = "all", seed: int = 42, validation_col: str | None = None) -> Pipeline:
    """Log-loss boosting. ``validation_col`` (boolean) turns on early stopping."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, stepSize=step, maxDepth=max_depth,
                        subsamplingRate=subsample, featureSubsetStrategy=subset, lossType="logistic", seed=seed,
                        maxBins=64, cacheNodeIds=False,  # walking a shallow tree is cheaper than keeping every row's node
                        maxMemoryInMB=1024, checkpointInterval=10)
    if weight:
        gbt.setWeightCol(weight)
    if validation_col:
        gbt.setValidationIndicatorCol(validation_col)
    return Pipeline(stages=[_assembler(features), gbt])


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """z(x) = sqrt(2/D) cos(Wx + b), W ~ N(0, 2γ), b ~ U[0, 2π): an explicit map
    whose inner products approximate the RBF kernel exp(-γ|x-y|²)
    (Rahimi & Recht 2007). One numpy matrix product per Arrow batch."""

    gamma = Param(Params._dummy(), "gamma", "RBF width", typeConverter=TypeConverters.toFloat)
    dim = Param(Params._dummy(), "dim", "number of random features", typeConverter=TypeConverters.toInt)
    nIn = Param(Params._dummy(), "nIn", "input dimension", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", typeConverter=TypeConverters.toInt)

    def __init__(self, inputCol="features", outputCol="rff", gamma=1.0, dim=256, nIn=1, seed=42):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, gamma=gamma, dim=dim, nIn=nIn, seed=seed)

    def _transform(self, df: DataFrame) -> DataFrame:
        g, D, d, s = (self.getOrDefault(p) for p in (self.gamma, self.dim, self.nIn, self.seed))
        rng = np.random.default_rng(s)
        W = rng.normal(0.0, math.sqrt(2.0 * g), size=(d, D))
        b = rng.uniform(0.0, 2 * math.pi, size=D)
        scale = math.sqrt(2.0 / D)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def rff(col: pd.Series) -> pd.Series:
            X = np.nan_to_num(np.stack(col.to_numpy()).astype(np.float64))
            Z = scale * np.cos(X @ W + b)
            return pd.Series(list(Z))

        arr = vector_to_array(F.col(self.getInputCol()))
        return df.withColumn(self.getOutputCol(), array_to_vector(rff(arr)))


# L3
def rbf_svm(features: Sequence[str], label: str = "target", weight: str | None = None, C: float = 1.0,
            gamma: float = 1.0, n_rows: int = 1000, dim: int = 256, seed: int = 42,
            max_iter: int = 100) -> Pipeline:
    """Approximate RBF SVM: Fourier features -> LinearSVC -> Platt scaling
    (logistic regression on the margin) for probabilities.

    The kernel SVM's primal C·Σhinge + ½|w|² equals LinearSVC's
    (1/n)Σhinge + (λ/2)|w|² with λ = 1/(C·n)."""
    svc = LinearSVC(featuresCol="rff", labelCol=label, regParam=1.0 / (C * max(n_rows, 1)), maxIter=max_iter,
                    rawPredictionCol="svm_raw", predictionCol="svm_pred", standardization=False)
    if weight:
        svc.setWeightCol(weight)
    margin = _Margin(inputCol="svm_raw", outputCol="margin")
    platt = LogisticRegression(featuresCol="margin", labelCol=label, maxIter=100)
    return Pipeline(stages=[_assembler(features), FourierFeatures("features", "rff", gamma, dim, len(features), seed),
                            svc, margin, platt])


class _Margin(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The class-1 margin of a raw prediction as a one-element vector."""

    def __init__(self, inputCol="svm_raw", outputCol="margin"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        m = vector_to_array(F.col(self.getInputCol()))[1]
        return df.withColumn(self.getOutputCol(), array_to_vector(F.array(m)))


# L4
def neural_network(features: Sequence[str], label: str = "target", hidden: Sequence[int] = (128, 64, 32),
                   max_iter: int = 50, block_size: int = 128, step: float = 0.001, seed: int = 42) -> Pipeline:
    mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label,
                                         layers=[len(features), *hidden, 2], maxIter=max_iter,
                                         blockSize=block_size, stepSize=step, seed=seed, solver="l-bfgs")
    return Pipeline(stages=[_assembler(features), mlp])


def default_gamma(df: DataFrame, features: Sequence[str]) -> float:
    """sklearn's gamma='scale': 1 / (n_features · variance of all feature values)."""
    arr = F.array(*[F.col(c).cast("double") for c in features])
    v = df.select(F.explode(arr).alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
    return 1.0 / (len(features) * v) if v > 0 else 1.0


# L6
def score(model: PipelineModel, df: DataFrame, label: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """class (int) and probability of class 1 (``score``)."""
    out = model.transform(df)
    cols = list(keep) + ([label] if label else [])
    return out.select(*cols, F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array("probability")[1].alias("score"))


# K6
def feature_importance(model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """Impurity importance per feature (sums to 1), largest first."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(list(zip(list(names), [float(x) for x in imp])),
                                 "feature string, importance double").orderBy(F.desc("importance"), "feature")


# L7
def training_history(model: PipelineModel) -> list[float]:
    """Per-iteration objective (loss) where MLlib records one (MLP, logistic regression)."""
    last = model.stages[-1]
    if not getattr(last, "hasSummary", False):  # tree ensembles keep no history
        return []
    summ = last.summary() if callable(last.summary) else last.summary
    return list(summ.objectiveHistory)


def f1_evaluator(label: str = "target") -> MulticlassClassificationEvaluator:
    """F1 of class 1 (the reference's ``scoring='f1'``), not the weighted F1."""
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction",
                                             metricName="fMeasureByLabel", metricLabel=1.0)
