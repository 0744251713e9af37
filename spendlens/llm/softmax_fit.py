"""Weighted softmax regression over many equally labelled rows, in few passes.

The objective is that of Spark's ``LogisticRegression`` (multinomial, L2 on the
coefficients): the weighted mean loss of a few known rows and of all ``rows``
of one label. A surrogate replaces ``rows`` by a bounded part of them plus a
linear term, which makes its gradient at the last model that of all rows
(surrogate likelihood, Jordan, Lee and Yang 2019). It is solved on the driver;
Spark sums loss and gradient over every row, once a round, so each row shapes
the model, and a point the rounds no longer leave is the fit over all rows.

Vectors are binary. Parameters are (features + 1, labels) arrays; the last row
holds the intercepts.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of a step of the local loss
_STEP = 500


class LocalLoss:
    """Summed loss and gradient of rows held on the driver."""

    def __init__(self, found: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, size: int):
        self.steps = []
        for lo in range(0, len(found), _STEP):
            part = [np.append(f, size) for f in found[lo : lo + _STEP]]
            at, length = np.concatenate(part).astype(np.int64), [len(f) for f in part]
            order = np.argsort(at, kind="stable")
            features, begin = np.unique(at[order], return_index=True)
            owner = np.repeat(np.arange(len(part)), length)[order]
            self.steps.append((at, np.cumsum([0, *length[:-1]]), owner, begin, features, labels[lo : lo + _STEP].astype(np.int64), weights[lo : lo + _STEP]))

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = 0.0, np.zeros_like(theta)
        for at, first, owner, begin, features, label, weight in self.steps:
            margin = np.add.reduceat(theta[at], first, axis=0)
            margin -= margin.max(1, keepdims=True)
            chance = np.exp(margin)
            total = chance.sum(1)
            own = np.arange(len(label))
            loss += float((weight * (np.log(total) - margin[own, label])).sum())
            chance /= total[:, None]
            chance[own, label] -= 1
            chance *= weight[:, None]
            gradient[features] += np.add.reduceat(chance[owner], begin, axis=0)
        return loss, gradient


def _norm(a: np.ndarray) -> float:
    return float(np.sqrt((a * a).sum()))


def minimise(loss, theta: np.ndarray, tol: float, steps: int = 300, memory: int = 20) -> np.ndarray:
    """L-BFGS with backtracking until the gradient's norm is at most ``tol``."""
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    value, gradient = loss(theta)
    for _ in range(steps):
        if _norm(gradient) <= tol:
            break
        way, shares = gradient.copy(), []
        for s, y, sy in reversed(moves):
            shares.append((s * way).sum() / sy)
            way -= shares[-1] * y
        if moves:
            s, y, sy = moves[-1]
            way *= sy / (y * y).sum()
        for (s, y, sy), share in zip(moves, reversed(shares)):
            way += s * (share - (y * way).sum() / sy)
        slope = (way * gradient).sum()
        step = 1.0 if moves else min(1.0, 1 / _norm(gradient))
        while True:
            then, after = loss(theta - step * way)
            if then <= value - 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        if then > value:  # no step goes down any more
            break
        s, y = -step * way, after - gradient
        if (sy := (s * y).sum()) > 1e-14 * _norm(s) * _norm(y):
            moves = [*moves[1 - memory :], (s, y, sy)]
        theta, value, gradient = theta + s, then, after
    return theta


def model_of(spark: SparkSession, theta: np.ndarray) -> LogisticRegressionModel:
    """Spark's model with these parameters: a fit whose bounds leave no other."""
    size, n = len(theta) - 1, theta.shape[1]
    ends = spark.range(2).select((F.col("id") * (n - 1)).cast("double").alias("label"), array_to_vector(F.array_repeat(F.col("id").cast("double"), size)).alias("vector"))
    weights, intercepts = DenseMatrix(n, size, theta[:-1].ravel()), DenseVector(theta[-1])  # column-major
    bounds = {"lowerBoundsOnCoefficients": weights, "upperBoundsOnCoefficients": weights, "lowerBoundsOnIntercepts": intercepts, "upperBoundsOnIntercepts": intercepts}
    return LogisticRegression(featuresCol="vector", labelCol="label", family="multinomial", maxIter=1, **bounds).fit(ends)


def summed_loss(model: LogisticRegressionModel, rows: DataFrame) -> tuple[float, np.ndarray]:
    """Summed loss of all ``rows``, whose label is 0, and its gradient."""
    chance = vector_to_array("probability").alias("chance")
    judged = model.transform(rows).select(F.inline(F.array(F.struct("vector", chance))))  # probabilities are found once a row
    p = [F.greatest(F.get("chance", F.lit(k)), F.lit(1e-300)) for k in range(model.numClasses)]
    sums = judged.agg(F.sum(-F.log(p[0])), F.array(*map(F.sum, p[1:])), *[Summarizer.metrics("normL1").summary(F.col("vector"), w) for w in p[1:]]).first()
    others = np.array([[*s.normL1.toArray(), b] for s, b in zip(sums[2:], sums[1])]).T
    return sums[0], np.hstack([-others.sum(1, keepdims=True), others])


def fit_in_rounds(known: DataFrame, rows: DataFrame, n_rows: int, weight: float, part: Column, size: int, n_labels: int, penalty: float, rounds: int = 4, tol: float = 1e-5) -> LogisticRegressionModel:
    """Fit on the few ``known`` rows (label, vector) of weight 1 and all ``rows`` (vector) of label 0 and ``weight`` each.

    ``part`` picks the rows of the surrogate; both it and ``known`` come to the
    driver, so they must be bounded. A round is one pass over all rows; the
    model of the least loss over all rows is returned.
    """
    spark = rows.sparkSession
    given = known.select("label", "vector").collect()
    few = [r.vector.indices for r in rows.where(part).select("vector").collect()]
    fixed = LocalLoss([r.vector.indices for r in given], np.array([r.label for r in given]), np.ones(len(given)), size)
    total = len(given) + weight * n_rows
    local = LocalLoss(few, np.zeros(len(few)), np.full(len(few), weight * n_rows / max(1, len(few))), size)
    theta = base = np.zeros((size + 1, n_labels))
    linear, bends, seen = np.zeros_like(theta), [], []  # what all rows add to the surrogate: slope at base, curvature

    def with_known(at: np.ndarray, loss: float, gradient: np.ndarray) -> tuple[float, np.ndarray]:
        (a, da), kept = fixed(at), np.vstack([at[:-1], np.zeros(n_labels)])
        return (a + loss) / total + penalty / 2 * (kept**2).sum(), (da + gradient) / total + penalty * kept

    def surrogate(at: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = with_known(at, *local(at))
        move = at - base
        loss, gradient = loss + (linear * move).sum(), gradient + linear
        for u in bends:
            along = (u * move).sum()
            loss, gradient = loss + along * along / 2, gradient + along * u
        return loss, gradient

    for _ in range(rounds):
        theta = minimise(surrogate, theta, tol)
        model = model_of(spark, theta)
        loss, gradient = summed_loss(model, rows)
        lacks = (weight * gradient - local(theta)[1]) / total
        value = with_known(theta, weight * loss, weight * gradient)[0]
        if seen:  # curvature the part lacks along this move, so that a step that went too far is not made again
            move = theta - base
            rest = lacks - linear - sum(u * (u * move).sum() for u in bends)
            if (bend := (rest * move).sum()) > 0:
                bends.append(rest / np.sqrt(bend))
        seen.append((value, model))
        if value <= min(v for v, _ in seen):
            base, linear = theta, lacks
        else:
            theta = base
    return min(seen, key=lambda s: s[0])[1]
