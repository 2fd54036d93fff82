"""The network's loss and gradient as array work on whole batches.

The same function as MLlib's multilayer perceptron: sigmoid layers, a softmax with
cross-entropy, weights in MLlib's order, the mean over blocks of ``block_size`` rows
of the blocks' means (so that rows of a partition's last, smaller block weigh more).
The steps are those of Breeze's L-BFGS, which MLlib uses. A pass sends one gradient a
task to the driver, and a task holds one Arrow batch of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.session import stored

# Breeze's settings
MEMORY = 10
TRIES = 10
# rows that are multiplied at once: their layers fit the cache
ROWS_AT_ONCE = 1024
LEAST_FALL, LEAST_FLAT = 1e-4, 0.9
VALUES_KEPT = 20


def blocks(rows: DataFrame, label: str, n: int, block_size: int, name: str = "blocks", learned: bool = True) -> DataFrame:
    """``rows`` (features, label) as packed numbers, about ``ROWS_AT_ONCE`` rows a record: n values, the
    label and the row's share of its block. Written once.

    learned: as in MLlib's fit, a value or label that is no finite number is an error; other
    rows only need a label to be measured."""
    step = max(ROWS_AT_ONCE // block_size, 1) * block_size

    def packed(batches):
        left = np.empty((0, n + 1))

        def record(x, size):
            return pa.RecordBatch.from_pydict({"rows": [len(x)], "numbers": [np.insert(x, n + 1, 1 / size, axis=1).tobytes()]})

        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n + 1)], axis=1)
            if learned and not (np.isfinite(x).all() and (x[:, n] >= 0).all() and (x[:, n] % 1 == 0).all()):
                raise ValueError("features must be finite numbers, labels whole numbers from 0")
            left = np.concatenate([left, x])
            whole = len(left) - len(left) % block_size
            for at in range(0, whole, step):
                yield record(left[at:min(at + step, whole)], block_size)
            left = left[whole:]
        if len(left):
            yield record(left, len(left))

    x = vector_to_array("features")
    flat = rows.select(*[x[i].alias(f"x{i}") for i in range(n)], F.col(label).cast("double"))
    flat = flat if learned else flat.filter(F.col(flat.columns[n]).isNotNull())
    return stored(flat.mapInArrow(packed, "rows long, numbers binary"), name)


def _unpacked(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def _forward(x: np.ndarray, net) -> list[np.ndarray]:
    """The layers' outputs, the probabilities last."""
    outs = [x]
    for i, (w, b) in enumerate(net):
        z = outs[-1] @ w + b
        if i < len(net) - 1:
            outs.append(1 / (1 + np.exp(-z)))
        else:
            e = np.exp(z - z.max(axis=1, keepdims=True))
            outs.append(e / e.sum(axis=1, keepdims=True))
    return outs


def _rows(batches, n: int):
    """(features, label, share) of a record's rows at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            x = np.frombuffer(batch.column(1)[at].as_buffer()).reshape(-1, n + 2)
            yield x[:, :n], x[:, n].astype(int), x[:, n + 1]


class Objective:
    """weights -> (loss, gradient) over all blocks; the last points are kept, as a line search asks for them again."""

    def __init__(self, data: DataFrame, layers: Sequence[int], block_size: int):
        self.data, self.layers, self.kept = data, list(layers), {}
        self.blocks = max(data.agg(F.sum(F.ceil(F.col("rows") / block_size))).first()[0] or 0, 1)

    def __call__(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        mark = weights.tobytes()
        if mark not in self.kept:
            self.kept = {k: self.kept[k] for k in list(self.kept)[-2:]}
            self.kept[mark] = self._pass(weights)
        return self.kept[mark]

    def _pass(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        layers = self.layers

        def sums(batches):
            net, loss, total = _unpacked(weights, layers), 0.0, np.zeros(weights.size)
            with np.errstate(all="ignore"):
                for x, y, share in _rows(batches, layers[0]):
                    outs, hot = _forward(x, net), np.eye(layers[-1])[y]
                    loss -= float(((hot * np.log(outs[-1])).sum(axis=1) * share).sum())
                    delta, grads = (outs[-1] - hot) * share[:, None], []
                    for i in range(len(net) - 1, -1, -1):
                        grads[:0] = [(outs[i].T @ delta).ravel(), delta.sum(axis=0)]
                        if i:
                            delta = (delta @ net[i][0].T) * outs[i] * (1 - outs[i])
                    total += np.concatenate(grads)
            yield pa.RecordBatch.from_pydict({"loss": [loss], "gradient": [total.tobytes()]})

        got = self.data.mapInArrow(sums, "loss double, gradient binary").collect()
        gradient = np.sum([np.frombuffer(bytes(r.gradient)) for r in got], axis=0) if got else np.zeros(weights.size)
        return math.fsum(r.loss for r in got) / self.blocks, gradient / self.blocks


def measured(data: DataFrame, weights: np.ndarray, layers: Sequence[int], least: float) -> tuple[float, float]:
    """(mean log loss, accuracy) over the rows; not a number without rows."""

    def sums(batches):
        net, n, loss, hits = _unpacked(weights, layers), 0, 0.0, 0
        with np.errstate(all="ignore"):
            for x, y, _ in _rows(batches, layers[0]):
                p = _forward(x, net)[-1]
                n, hits = n + len(y), hits + int((p.argmax(axis=1) == y).sum())
                loss -= float(np.log(np.maximum(p[np.arange(len(y)), y], least)).sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "loss": [loss], "hits": [hits]})

    n, loss, hits = data.mapInArrow(sums, "n long, loss double, hits long").agg(F.sum("n"), F.sum("loss"), F.sum("hits")).first()
    return (loss / n, hits / n) if n else (math.nan, math.nan)


class NoStep(Exception):
    """No step along this direction."""


def _between(a, b) -> float:
    """The least point of the cubic through two points (place, value, slope), kept off both ends."""
    (t, v, d), (u, w, e) = (a, b) if a[0] <= b[0] else (b, a)
    with np.errstate(all="ignore"):
        s = d + e - 3 * (v - w) / (t - u)
        r = float(np.sqrt(np.float64(s * s - d * e)))
        at = float(u - (u - t) * np.float64(e + r - s) / np.float64(e - d + 2 * r))
    low, high = t + 0.1 * (u - t), t + 0.9 * (u - t)
    return low if at < low else high if at > high else at


def _line(f: Callable, x: np.ndarray, direction: np.ndarray, t: float) -> float:
    """The length of a step that meets the strong Wolfe conditions."""

    def at(t: float) -> tuple[float, float, float]:
        value, gradient = f(x + direction * t)
        return t, value, float(gradient @ direction)

    low = at(0.0)
    value, slope = low[1:]
    if slope > 0:
        raise NoStep

    def zoom(low, high) -> float:
        for _ in range(TRIES):
            c = at(_between(low, high))
            if c[1] > value + LEAST_FALL * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= LEAST_FLAT * abs(slope):
                    return c[0]
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise NoStep

    for i in range(TRIES):
        c = at(t)
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + LEAST_FALL * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= LEAST_FLAT * abs(slope):
            return c[0]
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise NoStep


def _direction(gradient: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the approximate inverse Hessian (steps and gradient changes, the last first) times the gradient."""
    out, scale, back = gradient.copy(), 1.0, []
    if past:
        s, y = past[0]
        sy = float(s @ y)
        if sy < 0 or math.isnan(sy):
            raise NoStep
        scale = sy / float(y @ y) if y.any() else math.nan
    for s, y in past:
        rho = float(s @ y)
        a = float(s @ out) / rho if rho else math.nan
        if math.isnan(a):
            raise NoStep
        back.append((a, rho))
        out -= a * y
    out *= scale
    for (s, y), (a, rho) in zip(past[::-1], back[::-1]):
        out += (a - float(y @ out) / rho) * s
    return -out


def minimise(f: Callable, x: np.ndarray, steps: int, tolerance: float = 1e-6) -> np.ndarray:
    """At most ``steps`` L-BFGS steps from ``x``."""
    value, gradient = f(x)
    first, done, past, values, failed = value, 0, [], [math.inf], False
    while done < steps:
        if len(values) >= 2 and abs(value - max(values)) <= tolerance * first:
            break
        if np.linalg.norm(gradient) <= max(tolerance * value, 1e-8):
            break
        try:
            d = _direction(gradient, past)
            t = _line(f, x, d, 1.0 / float(np.linalg.norm(d)) if done == 0 else 1.0)
            if t * np.linalg.norm(gradient) < 1e-10:
                raise NoStep
        except NoStep:
            if failed:
                break
            failed, past = True, []
            continue
        new = x + d * t
        value, change = f(new)
        past = [(new - x, change - gradient), *past][:MEMORY]
        x, gradient, failed, done = new, change, False, done + 1
        values = [*values, value][-VALUES_KEPT:]
    return x
