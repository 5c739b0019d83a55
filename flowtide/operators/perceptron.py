"""Training of the perceptron over many rows: sigmoid layers, softmax, cross-entropy and L-BFGS as in Spark ML, with the
loss and its gradient worked out by matrix products over blocks of rows.

Blocks are written once. An evaluation is one job over all of them, of which every task sends one gradient; only weights
and gradients pass through the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from flowtide.session import materialize, spread

#: Rows of a written block, and of the part of it that is worked on at a time and stays in a core's cache.
_BLOCK, _PART = 16_384, 512
#: Pairs of steps that L-BFGS keeps, its tolerance, and the tries of a line search, as Spark ML has them.
_PAIRS, _TOLERANCE, _TRIES = 10, 1e-6, 10
#: A step must lower the loss by this share of its slope, and leave no more than that share of the slope.
_LOWER, _FLATTER = 1e-4, 0.9
#: The least probability in a log loss, as Spark's evaluator has it.
_LEAST = 1e-15


def blocks(rows: DataFrame) -> DataFrame:
    """``features`` and ``target`` in blocks of numbers, written once."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), _BLOCK):
                part = batch.iloc[start : start + _BLOCK]
                x = np.stack(part["x"].to_numpy()).astype(np.float32)
                if not np.isfinite(x).all() or part["y"].isna().any() or (part["y"] < 0).any():
                    raise ValueError("features must be finite numbers and targets class codes")
                y = part["y"].to_numpy().astype(np.int32)
                yield pd.DataFrame({"n": [len(part)], "x": [x.tobytes()], "y": [y.tobytes()]})

    plain = spread(rows.select(vector_to_array("features").alias("x"), rows["target"].cast("int").alias("y")))
    return materialize(plain.mapInPandas(packed, "n int, x binary, y binary"), "perceptron-blocks")


def _matrices(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights (inputs x outputs) and offsets of each layer, in the order in which Spark ML keeps them."""
    out, at = [], 0
    for inputs, outputs in zip(layers, layers[1:]):
        end = at + inputs * outputs
        out.append((weights[at:end].reshape(inputs, outputs), weights[end : end + outputs]))
        at = end + outputs
    return out


def _forward(x: np.ndarray, matrices: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """What every layer puts out; the last one, the logarithms of the probabilities."""
    out = [x]
    for i, (w, b) in enumerate(matrices):
        z = out[-1] @ w
        z += b
        if i < len(matrices) - 1:
            np.exp(np.negative(z, out=z), out=z)
            z += 1
            np.reciprocal(z, out=z)
        else:
            z -= z.max(axis=1, keepdims=True)
            z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        out.append(z)
    return out


def loss_and_gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, layers: Sequence[int]) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of some rows and its gradient."""
    matrices = _matrices(weights.astype(x.dtype), layers)
    out = _forward(x, matrices)
    loss = -float(out[-1][np.arange(len(y)), y].sum(dtype=np.float64))
    back = np.exp(out[-1])
    back[np.arange(len(y)), y] -= 1
    found = []
    for i in reversed(range(len(matrices))):
        found.append(np.concatenate(((out[i].T @ back).ravel(), back.sum(axis=0))))
        if i:
            back = back @ matrices[i][0].T
            back *= out[i]
            back *= 1 - out[i]
    return loss, np.concatenate(found[::-1]).astype(np.float64)


def _parts(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for x, y in zip(batch["x"], batch["y"]):
            x, y = np.frombuffer(x, np.float32).reshape(-1, width), np.frombuffer(y, np.int32)
            for start in range(0, len(y), _PART):
                yield x[start : start + _PART], y[start : start + _PART]


def mean_loss(table: DataFrame, weights: np.ndarray, layers: Sequence[int]) -> tuple[float, np.ndarray]:
    """Mean cross-entropy over all blocks, and its gradient."""

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, loss, gradient = 0, 0.0, np.zeros(len(weights))
        with np.errstate(over="ignore", invalid="ignore"):
            for x, y in _parts(batches, layers[0]):
                some = loss_and_gradient(x, y, weights, layers)
                n, loss, gradient = n + len(y), loss + some[0], gradient + some[1]
        yield pd.DataFrame({"n": [n], "loss": [loss], "gradient": [gradient.tobytes()]})

    found = table.mapInPandas(added, "n long, loss double, gradient binary").collect()
    n = sum(r["n"] for r in found)
    # in an order of their own, so that the sum is the same however tasks end
    found.sort(key=lambda r: (r["n"], r["loss"], bytes(r["gradient"])))
    return sum(r["loss"] for r in found) / n, sum(np.frombuffer(r["gradient"]) for r in found) / n


def log_loss(table: DataFrame, weights: np.ndarray, layers: Sequence[int]) -> float:
    """Mean log loss over all blocks, as ``MulticlassClassificationEvaluator`` has it."""

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrices, n, loss = _matrices(weights.astype(np.float32), layers), 0, 0.0
        with np.errstate(over="ignore", invalid="ignore"):
            for x, y in _parts(batches, layers[0]):
                own = _forward(x, matrices)[-1][np.arange(len(y)), y]
                n, loss = n + len(y), loss - float(np.maximum(own, np.log(_LEAST)).sum(dtype=np.float64))
        yield pd.DataFrame({"n": [n], "loss": [loss]})

    found = table.mapInPandas(added, "n long, loss double").collect()
    return sum(sorted(r["loss"] for r in found)) / sum(r["n"] for r in found)


Value = Callable[[np.ndarray], tuple[float, np.ndarray]]


def _along(value: Value, w: np.ndarray, f: float, g: np.ndarray, way: np.ndarray, step: float) -> tuple[np.ndarray, float, np.ndarray] | None:
    """A point along ``way`` that satisfies the strong Wolfe conditions; None if none is found."""
    slope = float(g @ way)
    if not slope < 0:
        return None

    def at(t: float) -> tuple[float, float, np.ndarray, float]:
        found, gradient = value(w + t * way)
        return t, found, gradient, float(gradient @ way)

    low, high = (0.0, f, g, slope), None
    for _ in range(_TRIES):
        here = at(step)
        if not np.isfinite(here[1]):
            step /= 2
            continue
        if here[1] > f + _LOWER * step * slope or (low[0] > 0 and here[1] >= low[1]):
            high = here
            break
        if abs(here[3]) <= _FLATTER * -slope:
            return w + step * way, here[1], here[2]
        if here[3] >= 0:
            low, high = here, low
            break
        low, step = here, step * 1.5
    for _ in range(_TRIES if high else 0):
        width = high[0] - low[0]
        # the lowest point of the parabola through both values and the slope at the lower one, kept off the ends
        bend = 2 * (high[1] - low[1] - low[3] * width)
        share = min(0.9, max(0.1, -low[3] * width / bend)) if bend > 0 else 0.5
        here = at(low[0] + share * width)
        if not here[1] <= f + _LOWER * here[0] * slope or here[1] >= low[1]:
            high = here
            continue
        if abs(here[3]) <= _FLATTER * -slope:
            return w + here[0] * way, here[1], here[2]
        if here[3] * width >= 0:
            high = low
        low = here
    return None


def lowest(value: Value, weights: np.ndarray, iterations: int) -> np.ndarray:
    """L-BFGS from ``weights``, so many iterations at most."""
    f, g = value(weights)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        if not np.linalg.norm(g) > max(_TOLERANCE * abs(f), 1e-8):
            break
        way, shares = -g, []
        for s, y in reversed(pairs):
            shares.append(float(s @ way) / float(s @ y))
            way = way - shares[-1] * y
        if pairs:
            s, y = pairs[-1]
            way = way * (float(s @ y) / float(y @ y))
        for (s, y), share in zip(pairs, reversed(shares)):
            way = way + (share - float(y @ way) / float(s @ y)) * s
        found = _along(value, weights, f, g, way, 1.0 if pairs else 1.0 / float(np.linalg.norm(way)))
        if found is None:
            if not pairs:
                break
            pairs = []
            continue
        s, y = found[0] - weights, found[2] - g
        weights, f, g = found
        if float(s @ y) > 0:
            pairs = [*pairs, (s, y)][-_PAIRS:]
    return weights


def fitted(table: DataFrame, weights: np.ndarray, layers: Sequence[int], iterations: int) -> np.ndarray:
    """Weights after so many epochs over all blocks."""
    return lowest(lambda w: mean_loss(table, w, layers), weights, iterations)
