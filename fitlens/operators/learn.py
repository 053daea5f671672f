"""Weights learned from labels: logistic regression without a pass of Python over the rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlens.functions.text import _as_column
from fitlens.operators.rows import stored

INTERCEPT = "intercept"


@dataclass(frozen=True)
class Logistic:
    """Weights by feature, with the intercept, and what the fit came to."""

    weights: Mapping[str, float]
    rounds: int
    converged: bool

    def probability(self, features: Mapping[str, Column] | None = None) -> Column:
        """Probability of the label as a column, of the features' columns or of those of these names."""
        total = F.lit(self.weights[INTERCEPT])
        for name, weight in self.weights.items():
            if name != INTERCEPT:
                value = (features or {}).get(name, F.col(name))
                total = total + F.coalesce(value.cast("double"), F.lit(0.0)) * F.lit(weight)
        return 1 / (1 + F.exp(-total))


def signal_features(text: Column | str, signals: Sequence[tuple[str, float]]) -> dict[str, Column]:
    """One 0/1 column per pattern of a list of signals, as ``functions.sections.confidence`` tests them."""
    low = F.lower(_as_column(text))
    return {f"signal_{k}": F.coalesce(low.rlike(pattern), F.lit(False)).cast("double") for k, (pattern, _) in enumerate(signals)}


def fit_logistic(df: DataFrame, label: Column | str, features: Mapping[str, Column], ridge: float = 0.0,
                 most_rounds: int = 50, tolerance: float = 1e-10) -> Logistic:
    """Logistic regression of a boolean label by iteratively reweighted least squares.

    A round is one aggregate: the gradient and the curvature, a number for each pair of features, whatever
    the rows; the small system is solved on the driver. A step that makes the likelihood worse is
    halved. Rows without label do not count, missing features count as 0. ``ridge`` draws the
    weights (not the intercept) to zero; without it, features that tell the labels apart without
    error, or repeat one another, have no finite or no single solution, and the fit says so in
    ``converged`` or raises ``ValueError``."""
    names = list(features)
    columns = [F.lit(1.0), *[F.coalesce(c.cast("double"), F.lit(0.0)) for c in features.values()]]
    k = len(columns)
    # Rows with the same features and label count once, with their number.
    rows = stored(df.select(_as_column(label).cast("boolean").cast("double").alias("y"), *[
        c.alias(f"x{i}") for i, c in enumerate(columns)]).filter("y is not null").groupBy("y", *[f"x{i}" for i in range(k)]).agg(
        F.count(F.lit(1)).cast("double").alias("n")))
    pull = np.full(k, ridge)
    pull[0] = 0.0
    x = [F.col(f"x{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def measured(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = sum((x[i] * F.lit(float(beta[i])) for i in range(1, k)), F.lit(float(beta[0])))
        known = rows.withColumn("z", z).withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
        # log(1 + exp(z)) without overflow.
        soft = F.greatest(F.col("z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("z")))
        row = known.agg(
            F.sum(F.col("n") * (F.col("y") * F.col("z") - soft)),
            *[F.sum(F.col("n") * (F.col("y") - F.col("p")) * x[i]) for i in range(k)],
            *[F.sum(F.col("n") * F.col("p") * (1 - F.col("p")) * x[i] * x[j]) for i, j in pairs]).first()
        if row[0] is None:
            raise ValueError("no row has a label")
        gradient, curvature = np.array(row[1:k + 1]) - pull * beta, np.diag(pull)
        for (i, j), value in zip(pairs, row[k + 1:]):
            curvature[i, j] += value
            curvature[j, i] = curvature[i, j]
        return row[0] - float(pull @ beta ** 2) / 2, gradient, curvature

    beta = np.zeros(k)
    value, gradient, curvature = measured(beta)
    for done in range(1, most_rounds + 1):
        if np.linalg.cond(curvature) > 1e13:
            if done == 1:
                raise ValueError("some features are sums of others; leave one out or give a ridge")
            break
        step = np.linalg.solve(curvature, gradient)
        for _ in range(30):
            after = measured(beta + step)
            if after[0] >= value - 1e-12 * abs(value):
                break
            step = step / 2
        beta, (value, gradient, curvature) = beta + step, after
        if np.abs(step).max() <= tolerance * max(1.0, np.abs(beta).max()):
            return Logistic(dict(zip([INTERCEPT, *names], beta.tolist())), done, True)
    return Logistic(dict(zip([INTERCEPT, *names], beta.tolist())), done, False)


def learned_signals(df: DataFrame, text: Column | str, label: Column | str, signals: Sequence[tuple[str, float]],
                    ridge: float = 1.0) -> tuple[Logistic, tuple[tuple[str, float], ...]]:
    """The signals of a confidence with weights learned from labelled items, and the fit. A signal that
    turns the odds by a factor of e counts a quarter, the most by which it moves a probability."""
    fit = fit_logistic(df, label, signal_features(text, signals), ridge)
    weights = [fit.weights[f"signal_{k}"] / 4 for k in range(len(signals))]
    return fit, tuple((pattern, round(w, 6)) for (pattern, _), w in zip(signals, weights) if math.isfinite(w))
