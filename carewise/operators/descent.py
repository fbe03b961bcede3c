"""Multinomial logistic regression whose result does not depend on partitions, tasks or engines.

``minimise`` goes on to the optimum, by L-BFGS in double precision: the loss has one optimum, and what
is left of the slopes is so small that its first nine places are the same however sums are ordered.
``descend`` takes a given number of steps. For it, features, coefficients and the error of each row are whole numbers of fixed units, so every sum over
rows is a sum of whole numbers, the same in any order. The rest of a step works on single coefficients.
The number of steps is a parameter; each is one pass over the rows in which only sums per
coefficient leave a task.
"""

from __future__ import annotations

import sys
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Units of features and errors, and of coefficients.
FEATURE_UNIT = 10**6
ERROR_UNIT = 10**6
COEFFICIENT_UNIT = 10**9
RATE = 0.5
TINY = 1e-8
# The optimum is found when no slope of the mean loss is larger.
STEEPEST = 1e-13
# Changes of slopes that L-BFGS remembers.
REMEMBERED_CHANGES = 10
# Sums of a task leave it when its rows weigh this much, far below 64 bits.
MOST_WEIGHT = 4_000_000
# Features that are multiplied at once.
TAKEN_FEATURES = 32_768

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def errors(margins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weight times (probability less truth) in units of errors."""
    m = margins / float(FEATURE_UNIT * COEFFICIENT_UNIT)
    powers = np.exp(m - m.max(axis=1, keepdims=True))
    share = powers / powers.sum(axis=1, keepdims=True)
    share[np.arange(len(label)), label] -= 1.0
    return np.rint(weight[:, None] * share * ERROR_UNIT).astype(np.int64)


def _sums(coefficients: np.ndarray):
    """Gradient sums per task: (at, g), ``at`` being the place in the flat matrix (feature, class)."""
    features, classes = coefficients.shape

    def out(g: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(g)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(g.ravel()[at])], ["at", "g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held = np.zeros((features, classes), dtype=np.int64), 0.0
        for batch in batches:
            ends = np.cumsum(np.asarray(pa.compute.list_value_length(batch.column("at")), dtype=np.int64))
            all_at = np.asarray(batch.column("at").flatten(), dtype=np.int64)
            all_x = np.asarray(batch.column("x").flatten(), dtype=np.int64)
            labels, weights = (np.asarray(batch.column(c)) for c in ("label", "weight"))
            first = 0
            while first < len(ends):
                begin = ends[first - 1] if first else 0
                end = max(first + 1, int(np.searchsorted(ends, begin + TAKEN_FEATURES, side="right")))
                at, x = all_at[begin:ends[end - 1]], all_x[begin:ends[end - 1]]
                sizes, label, weight = np.diff(ends[first:end], prepend=begin), labels[first:end], weights[first:end]
                first = end
                error = errors(np.add.reduceat(x[:, None] * coefficients[at], np.cumsum(sizes) - sizes), label, weight)
                if held + weight.sum() > MOST_WEIGHT:
                    yield out(g)
                    g, held = np.zeros_like(g), 0.0
                held += float(weight.sum())
                order = np.argsort(at, kind="stable")
                firsts = np.flatnonzero(np.diff(at[order], prepend=-1))
                owner = np.repeat(np.arange(len(sizes)), sizes)[order]
                g[at[order[firsts]]] += np.add.reduceat(x[order, None] * error[owner], firsts)
        yield out(g)

    return run


def descend(rows: DataFrame, features: int, classes: int, total: float, ridge: float, steps: int) -> np.ndarray:
    """Coefficients (feature, class) after ``steps`` steps of adaptive gradient descent.

    ``rows`` has (label int, weight double, at array<int>, x array<long>); every row holds the last
    feature, the intercept, as one unit. It has no ridge penalty. The matrix lies on the driver, as the model does.
    """
    c = np.zeros((features, classes), dtype=np.int64)
    seen = np.zeros((features, classes))
    penalty = np.full((features, 1), ridge)
    penalty[-1] = 0.0
    for _ in range(steps):
        sums = rows.mapInArrow(_sums(c), "at long, g long").groupBy("at").agg(F.sum(F.col("g").cast("decimal(38,0)")).cast("double").alias("g"))
        found = sums.toPandas()  # at most a row per coefficient
        g = np.zeros(features * classes)
        g[found["at"].to_numpy(dtype=np.int64)] = found["g"].to_numpy()
        value = c / float(COEFFICIENT_UNIT)
        slope = g.reshape(features, classes) / (float(FEATURE_UNIT * ERROR_UNIT) * total) + penalty * value
        seen = seen + slope * slope
        c = np.rint((value - RATE * slope / (np.sqrt(seen) + TINY)) * COEFFICIENT_UNIT).astype(np.int64)
    return c / float(COEFFICIENT_UNIT)


def _slopes(shared: Broadcast):
    """Sums per task of the gradient at the shared coefficients, as (at, g) like in ``_sums``, and of the loss, at -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coefficients = shared.value
        features, classes = coefficients.shape
        g, loss = np.zeros((features, classes)), 0.0
        for batch in batches:
            ends = np.cumsum(np.asarray(pa.compute.list_value_length(batch.column("at")), dtype=np.int64))
            all_at = np.asarray(batch.column("at").flatten(), dtype=np.int64)
            all_x = np.asarray(batch.column("x").flatten(), dtype=np.float64)
            labels, weights = (np.asarray(batch.column(c)) for c in ("label", "weight"))
            first = 0
            while first < len(ends):
                begin = ends[first - 1] if first else 0
                end = max(first + 1, int(np.searchsorted(ends, begin + TAKEN_FEATURES, side="right")))
                at, x = all_at[begin:ends[end - 1]], all_x[begin:ends[end - 1], None]
                sizes, label, weight = np.diff(ends[first:end], prepend=begin), labels[first:end], weights[first:end]
                first = end
                m = np.add.reduceat(x * coefficients[at], np.cumsum(sizes) - sizes)
                m -= m.max(axis=1, keepdims=True)
                share, rows = np.exp(m), np.arange(len(label))
                total = share.sum(axis=1, keepdims=True)
                loss += float((weight * (np.log(total[:, 0]) - m[rows, label])).sum())
                share /= total
                share[rows, label] -= 1.0
                error = weight[:, None] * share
                order = np.argsort(at, kind="stable")
                firsts = np.flatnonzero(np.diff(at[order], prepend=-1))
                g[at[order[firsts]]] += np.add.reduceat(x[order] * error[np.repeat(rows, sizes)[order]], firsts)
        there = np.flatnonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(g.ravel()[there], loss))], ["at", "g"])

    return run


def lbfgs(slope_of: Callable[[np.ndarray], tuple[float, np.ndarray]], curvature: np.ndarray, max_iter: int, steepest: float = STEEPEST) -> np.ndarray:
    """Where a convex function, given with its slopes, is least, from zero on; ``curvature`` is about its second derivatives.

    A step counts when the function gets smaller by enough. Near the end, where it no longer differs, the
    slope along the step has to (the approximate condition of Hager and Zhang).
    """
    c = np.zeros_like(curvature)
    f, g = slope_of(c)
    changes: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        if np.abs(g).max() <= steepest:
            return c
        d, parts = -g, []
        for s, y, sy in reversed(changes):
            parts.append(float((s * d).sum()) / sy)
            d = d - parts[-1] * y
        d = d / curvature
        if changes:
            s, y, sy = changes[-1]
            d *= sy / float((y * y / curvature).sum())
        for (s, y, sy), part in zip(changes, reversed(parts)):
            d = d + (part - float((y * d).sum()) / sy) * s
        fall, t = float((g * d).sum()), 1.0
        for _ in range(40):
            new_f, new_g = slope_of(c + t * d)
            along = float((new_g * d).sum())
            if new_f <= f + 0.1 * t * fall or new_f <= f + 1e-10 * abs(f) and along <= -0.8 * fall:
                break
            t *= min(0.5, max(0.1, fall / (fall - along)))
        else:
            break
        s, y = t * d, new_g - g
        c, f, g = c + s, new_f, new_g
        if (sy := float((s * y).sum())) > 0:
            changes = [*changes[1 - REMEMBERED_CHANGES:], (s, y, sy)]
    if np.abs(g).max() > steepest:
        warnings.warn(f"the classifier did not converge: a slope of {np.abs(g).max():.3g} is left", stacklevel=3)
    return c


def minimise(rows: DataFrame, features: int, classes: int, total: float, ridge: float, max_iter: int) -> np.ndarray:
    """The coefficients (feature, class) of the least loss, by at most ``max_iter`` rounds of L-BFGS.

    ``rows`` is like that of ``descend``, x being in ones. A pass over the rows gives the loss and its slopes.
    """
    penalty = np.full((features, 1), ridge)
    penalty[-1] = 0.0
    squares = rows.select("weight", F.explode(F.arrays_zip("at", "x")).alias("f")).groupBy("f.at").agg(F.sum(F.col("weight") * F.col("f.x") * F.col("f.x")).alias("g"))
    found = squares.toPandas()  # a row per feature
    curvature = np.zeros((features, classes))
    curvature[found["at"].to_numpy(dtype=np.int64)] = found["g"].to_numpy()[:, None] / total * (1 - 1 / classes) / classes
    curvature += np.maximum(penalty, TINY)

    def slope_of(c: np.ndarray) -> tuple[float, np.ndarray]:
        # not part of the plan, of which the driver would keep one per pass
        shared = rows.sparkSession.sparkContext.broadcast(c)
        found = rows.mapInArrow(_slopes(shared), "at long, g double").groupBy("at").agg(F.sum("g").alias("g")).toArrow()
        shared.destroy()
        at, own = found["at"].to_numpy(), found["g"].to_numpy()
        g = np.zeros(features * classes)
        g[at[at >= 0]] = own[at >= 0]
        return own[at < 0].sum() / total + 0.5 * float((penalty * c * c).sum()), g.reshape(features, classes) / total + penalty * c

    return lbfgs(slope_of, curvature, max_iter)
