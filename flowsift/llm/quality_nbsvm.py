"""Quality classifier: Naive Bayes support vectors.

A text's features are indicators of hashed n-grams: its words and pairs of words,
and runs of one to three word shapes (upper, lower, digits and other characters,
repeats collapsed; a word that repeats the one before it has a mark). Each
indicator is scaled by its log-count ratio between the classes, counted by Spark
over all learning rows; a linear hinge-loss model is fitted on the scaled
indicators by dual coordinate descent and interpolated with Naive Bayes: a scaled
indicator weighs (1 - MIX) * mean|w| + MIX * w, so an n-gram that no fitted row
holds keeps its ratio. The margin becomes a probability by a logistic fit on rows
the descent hasn't seen.

The descent visits one row at a time, so it runs in one process, on at most
FIT_ROWS learning rows, drawn by a hash of the id (a fifth of them for the
logistic fit). Counts cover all learning rows, scores all rows.

Nulls and ties: a null or empty text has no feature and gets the score of a
margin of 0; labels that are null or not 0 or 1, or whose document isn't
there, teach nothing; a document with several labels teaches each; if a class
has no learning row, every score is the share of class 1 (0.5 without rows).
An empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.llm.base import ByteCache, quoted
from flowsift.session import cut_lineage, maybe_broadcast

BITS = 18             # the feature space has 2 ** BITS indicators
FIT_ROWS = 20_000     # learning rows that the descent may use
SMOOTH = 1.0
MIX = 0.25            # share of the fitted weights, against their mean size, which weighs the plain ratios
COST = 1.0
EPOCHS = 8

_RUNS = re.compile(r"(.)\1+", re.S)
_HASH = struct.Struct("<Q")
_M = np.uint64(0x9E3779B97F4A7C15)


class _Kinds(dict):
    """The kind of every character met so far, by its code point."""

    def __missing__(self, at: int) -> str:
        c = chr(at)
        kind = self[at] = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        return kind


_KINDS = _Kinds()


def shape(word: str) -> str:
    return _RUNS.sub(r"\1", word.translate(_KINDS))


def _form(kinds: str) -> bytes:
    return _HASH.pack(xxhash.xxh64_intdigest(_RUNS.sub(r"\1", kinds).encode("utf-8", "surrogatepass")))


_FORMS = ByteCache(_form)  # words never seen have few kinds of shapes


def _token(w: str) -> bytes:
    """A word's hash and its shape's hash, 16 bytes."""
    return _HASH.pack(xxhash.xxh64_intdigest(w.lower().encode("utf-8", "surrogatepass"))) + _FORMS[w.translate(_KINDS)]


_TOKENS = ByteCache(_token)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    ws = text.split() if text else []
    if not ws:
        return np.empty(0, np.int32)
    t = np.frombuffer(b"".join(map(_TOKENS.__getitem__, ws)), "<u8").reshape(-1, 2)
    word, form = t[:, 0], t[:, 1].copy()
    form[1:][word[1:] == word[:-1]] ^= np.uint64(0x5555555555555555)
    two = (form[:-1] * _M) ^ form[1:]
    three = (two[:-1] * _M) ^ form[2:]
    pair = (word[:-1] * _M) ^ word[1:]
    parts = [word + np.uint64(1), form * np.uint64(3), two * np.uint64(5), three * np.uint64(7), pair * np.uint64(11)]
    h = np.concatenate([p * _M for p in parts]) >> np.uint64(64 - BITS)
    return np.unique(h.astype(np.int32))


def _feature_batches(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([features(t.as_py()) for t in b.column(2)], pa.list_(pa.int32()))],
            names=["key", "y", "f"])


class QualityModel:
    """weights: of the indicators, their ratios folded in; scale: the ratios;
    slope and shift: of the logistic curve; constant: the score if nothing was learned."""

    def __init__(self, weights=None, scale=None, slope=1.0, shift=0.0, constant=None):
        self.weights, self.scale, self.slope, self.shift, self.constant = weights, scale, slope, shift, constant

    def margin(self, f: np.ndarray) -> float:
        norm = float(np.sqrt((self.scale[f] ** 2).sum()))
        return float(self.weights[f].sum()) / norm if norm > 0 else 0.0

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        z = self.slope * self.margin(features(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = COST,
            epochs: int = EPOCHS, seed: int = 4) -> np.ndarray:
    """Weights of the L2-regularised hinge loss over unit rows of scaled
    indicators, by dual coordinate descent; classes weigh alike in sum."""
    w, dual = np.zeros(len(scale)), np.zeros(len(rows))
    values = [scale[f] / max(1e-12, float(np.sqrt((scale[f] ** 2).sum()))) for f in rows]
    share = {c: max(1, int((y == c).sum())) for c in (-1, 1)}
    top = np.array([cost * len(y) / (2 * share[int(c)]) for c in y])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, x = rows[i], values[i]
            if not len(f):
                continue
            g = y[i] * float(w[f] @ x) - 1
            new = min(max(dual[i] - g, 0.0), top[i])  # rows are of unit length
            if new != dual[i]:
                w[f] += (new - dual[i]) * y[i] * x
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-3:
            break
    return w


def interpolated(w: np.ndarray, seen: np.ndarray, mix: float = MIX) -> np.ndarray:
    """Weights of the scaled indicators between the fitted ones and their mean size over
    the indicators ``seen`` in learning rows; others have a ratio of about 0 anyway."""
    return (1 - mix) * float(np.abs(w[seen]).mean() if len(seen) else 0) + mix * w


def logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of P(y = 1 | margin), by Newton steps with smoothed targets."""
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.c_[m, np.ones(len(m))]
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-6 * theta)
        theta = theta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                label: str = "quality") -> QualityModel:
    """Learn from all given documents with a label 0 or 1."""
    lab = labels.select(quoted(doc_id).alias("key"), quoted(label).cast("int").alias("y")).filter("y in (0, 1)")
    body = docs.select(quoted(doc_id).alias("key"), quoted(text).alias("text"))
    rows = body.join(maybe_broadcast(lab), "key").select(F.col("key").cast("string").alias("key"), "y", "text")
    rows = cut_lineage(rows.mapInArrow(_feature_batches, "key string, y int, f array<int>"))
    n0, n1 = rows.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    if not (n0 and n1):
        return QualityModel(constant=0.5 if not n0 + n1 else float(n1 > 0))
    counts = (rows.select("y", F.explode("f").alias("f")).groupBy("f")
              .agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).toPandas())  # 2 ** BITS rows at most
    p, q = np.full(2 ** BITS, SMOOTH), np.full(2 ** BITS, SMOOTH)
    p[counts.f], q[counts.f] = counts.n1 + SMOOTH, counts.n0 + SMOOTH
    scale = np.log(p / p.sum()) - np.log(q / q.sum())
    # thinned by the same hash before they are ordered, so that no task meets more than it needs
    draw, cells = F.pmod(F.xxhash64("key"), F.lit(1 << 30)), 1 << 30
    share = min(1.0, (1.05 * FIT_ROWS + 500) / (n0 + n1))
    got = (rows.filter(draw < int(share * cells)).orderBy(draw, "key", "y").limit(FIT_ROWS)
           .select("key", "y", "f").toArrow())
    rows_f = [np.asarray(f.values) for f in got.column("f")]
    y = np.where(got.column("y").to_numpy() == 1, 1, -1)
    hold = np.arange(len(y)) % 5 == 4
    if len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
        hold = np.zeros(len(y), bool)  # too few rows to set some aside
    w = descend([f for f, h in zip(rows_f, hold) if not h], y[~hold], scale)
    model = QualityModel(interpolated(w, counts.f.to_numpy()) * scale, scale)
    on = hold if hold.any() else ~hold
    m = np.array([model.margin(f) for f, o in zip(rows_f, on) if o])
    model.slope, model.shift = logistic(m, y[on])
    return model


def quality_score(df: DataFrame, model: QualityModel, text: str = "text") -> Column:
    """Probability of class 1 (double) of each row's text."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(batch):
        import pandas as pd
        return pd.Series([sent.value.score(t) for t in batch], dtype=float)

    return scored(quoted(text))
