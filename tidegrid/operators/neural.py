"""Multilayer perceptrons trained over all rows of a table.

The net is MLlib's: sigmoid layers, a softmax at the end, cross-entropy, MLlib's own first weights,
limited-memory BFGS steps under the strong Wolfe conditions. Rows are packed once into blocks of
numbers, dealt evenly over the tasks. A pass is one job: every task adds up the gradient of its
blocks by matrix products and gives one row of sums; the driver holds weights and sums, never rows.
The trained weights become an MLlib model.

Sets of at most ``MLLIB_ROWS`` rows stay with MLlib's own trainer (``models.fit_candidate``). Both take
the same steps; sums are rounded otherwise here, and MLlib weighs a partial block like a full one, so
the weights that the two end at differ, as MLlib's own do with the partitions its rows come in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of one matrix product, and rows of a task at least and (beyond the cores) at most
BLOCK_ROWS, LEAST_ROWS, MOST_ROWS = 1024, 2048, 200_000
#: rows of a set that MLlib trains itself
MLLIB_ROWS = 50_000
CORRECTIONS = 10
#: Wolfe conditions: decrease, curvature, trials of a search
DECREASE, CURVATURE, TRIALS = 1e-4, 0.9, 10


def with_weights(spark: SparkSession, estimator: MultilayerPerceptronClassifier, weights: np.ndarray | None = None) -> MultilayerPerceptronClassificationModel:
    """The MLlib model of given weights; of its own first weights where none are given."""
    still = estimator.copy().setMaxIter(0)
    if weights is not None:
        still.setInitialWeights(Vectors.dense(weights))
    one = spark.createDataFrame([(0.0, Vectors.dense([0.0] * estimator.getLayers()[0]))], ["label", "features"])
    return still.setLabelCol("label").setFeaturesCol("features").fit(one)


def _affine(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix (inputs x outputs) and offsets of every layer, in the order that MLlib keeps them."""
    out, at = [], 0
    for i, o in zip(layers, layers[1:]):
        out.append((weights[at : at + i * o].reshape(i, o), weights[at + i * o : at + i * o + o]))
        at += i * o + o
    return out


def loss_and_gradient(weights: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over rows of the cross-entropy and of its gradient."""
    steps = _affine(weights, layers)
    seen = [x]
    for k, (w, b) in enumerate(steps):
        z = seen[-1] @ w + b
        if k < len(steps) - 1:
            with np.errstate(over="ignore"):
                z = 1.0 / (1.0 + np.exp(-z))
        seen.append(z)
    z = seen.pop()
    z -= z.max(axis=1, keepdims=True)
    logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    rows = np.arange(len(y))
    delta = np.exp(logs)
    delta[rows, y] -= 1.0
    parts = []
    for k in range(len(steps) - 1, -1, -1):
        parts += [delta.sum(axis=0), (seen[k].T @ delta).reshape(-1)]
        if k:
            delta = (delta @ steps[k][0].T) * seen[k] * (1.0 - seen[k])
    return -float(logs[rows, y].sum()), np.concatenate(parts[::-1])


def packed(ready: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """x, y: blocks of features and labels as bytes, dealt evenly whatever partitions ``ready`` has."""
    cores = ready.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(cores, -(-rows // LEAST_ROWS)), -(-rows // MOST_ROWS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int8)
            starts = range(0, len(y), BLOCK_ROWS)
            yield pa.RecordBatch.from_arrays([
                pa.array([a[s : s + BLOCK_ROWS].tobytes() for s in starts], pa.binary()) for a in (x, y)], names=["x", "y"])

    even = ready.select("label", *columns).repartition(tasks).sortWithinPartitions("label", *columns)
    return even.mapInArrow(pack, "x binary, y binary")


def mean_loss(blocks: DataFrame, layers: list[int], rows: int) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Mean loss and gradient over all blocks, by one job a call."""
    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, gradient = 0.0, np.zeros(len(weights))
            for batch in batches:
                for x, y in zip(batch.column("x"), batch.column("y")):
                    got = loss_and_gradient(
                        weights, layers, np.frombuffer(x.as_buffer()).reshape(-1, layers[0]), np.frombuffer(y.as_buffer(), dtype=np.int8))
                    loss, gradient = loss + got[0], gradient + got[1]
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], names=["loss", "gradient"])

        # one row a task; added up in the order of the tasks, so that runs agree
        found = blocks.mapInArrow(sums, "loss double, gradient binary").collect()
        total = np.sum([np.frombuffer(r["gradient"]) for r in found], axis=0)
        return sum(r["loss"] for r in found) / rows, total / rows

    return at


def _direction(gradient: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton step of the last changes of weights and gradient."""
    q, shares = gradient.copy(), []
    for s, y in reversed(past):
        shares.append(s @ q / (s @ y))
        q -= shares[-1] * y
    if past:
        s, y = past[-1]
        q *= s @ y / (y @ y)
    for (s, y), a in zip(past, reversed(shares)):
        q += (a - y @ q / (s @ y)) * s
    return -q


def _between(a: tuple, b: tuple) -> float:
    """Where the cubic through two trials (step, loss, slope) is least, kept off their ends."""
    d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
    root = np.sqrt(max(d1 * d1 - a[2] * b[2], 0.0))
    under = b[2] - a[2] + 2 * root
    t = b[0] - (b[0] - a[0]) * (b[2] + root - d1) / under if under else a[0]
    ends = sorted((a[0] + 0.1 * (b[0] - a[0]), a[0] + 0.9 * (b[0] - a[0])))
    return min(max(t, ends[0]), ends[1])


def _search(trial: Callable[[float], tuple], start: tuple, step: float) -> tuple | None:
    """A trial that meets the strong Wolfe conditions, else the best that goes down enough, or None."""
    def steep(c: tuple) -> bool:
        return c[1] > start[1] + DECREASE * c[0] * start[2]

    low, high = start, None
    for n in range(TRIALS):
        c = trial(step)
        if not np.isfinite(c[1]):
            step /= 2
            continue
        if steep(c) or (n and c[1] >= low[1]):
            high = c
            break
        if abs(c[2]) <= CURVATURE * abs(start[2]):
            return c
        if c[2] >= 0:
            low, high = c, low
            break
        low, step = c, step * 1.5
    if high is None:
        return low if low[0] else None
    for _ in range(2 * TRIALS):
        c = trial(_between(low, high) if low[1] > high[1] else _between(high, low))
        if steep(c) or c[1] >= low[1]:
            high = c
            continue
        if abs(c[2]) <= CURVATURE * abs(start[2]):
            return c
        if c[2] * (high[0] - low[0]) >= 0:
            high = low
        low = c
    return low if low[0] else None


def minimise(at: Callable[[np.ndarray], tuple[float, np.ndarray]], weights: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """At most ``steps`` steps down from ``weights``; ends when the loss or its gradient stands still."""
    loss, gradient = at(weights)
    first, losses, past = loss, [loss], []
    for _ in range(steps):
        if not np.isfinite(loss) or np.linalg.norm(gradient) <= max(tolerance * abs(loss), 1e-8):
            break
        found = None
        while found is None:
            d = _direction(gradient, past)
            seen = {}

            def trial(t: float) -> tuple:
                seen[t] = at(weights + t * d)
                return t, seen[t][0], float(seen[t][1] @ d)

            slope = float(gradient @ d)
            found = _search(trial, (0.0, loss, slope), 1.0 if past else 1.0 / np.linalg.norm(d)) if slope < 0 else None
            if found is None and not past:
                return weights
            if found is None:
                past = []  # once more, straight down
        moved, (after, changed) = found[0] * d, seen[found[0]]
        past = [*past, (moved, changed - gradient)][-CORRECTIONS:]
        weights, loss, gradient = weights + moved, after, changed
        if abs(max(losses) - loss) <= tolerance * abs(first):
            break
        losses = [*losses, loss][-20:]
    return weights


def fit(ready: DataFrame, columns: list[str], estimator: MultilayerPerceptronClassifier) -> MultilayerPerceptronClassificationModel:
    """The trained net on ``ready`` (label, and ``columns`` without gaps)."""
    spark, layers = ready.sparkSession, list(estimator.getLayers())
    rows = ready.count()
    weights = with_weights(spark, estimator).weights.toArray()
    if rows:
        blocks = packed(ready, columns, rows).cache()
        weights = minimise(mean_loss(blocks, layers, rows), weights, estimator.getMaxIter(), estimator.getTol())
        blocks.unpersist()
    return with_weights(spark, estimator, weights)
