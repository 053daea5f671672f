import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitlens.functions.sections import QUALIFICATION_SIGNALS, confidence
from fitlens.operators import agreement, learn, quantile


@pytest.mark.parametrize("few", [1, 50, 10_000])
def test_exact_quantiles(spark, monkeypatch, few):
    """Ties, a hot value, far ends, infinities, values that differ in the last bit."""
    monkeypatch.setattr(quantile, "FEW", few)
    monkeypatch.setattr(quantile, "CELLS", 16)
    rng = np.random.default_rng(1)
    probabilities = (0.0, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0)
    for values in (rng.normal(size=701), rng.integers(0, 5, 300).astype(float), np.where(rng.random(400) < 0.6, 7.0, rng.normal(size=400)),
                   np.exp(rng.normal(scale=90, size=200)), np.array([1.7e308, -1.7e308, 0.0, 1e-320, 5e-324]),
                   np.nextafter(1.0, 2.0) * np.ones(9), np.array([1.0, np.nextafter(1.0, 2.0)] * 40), np.array([3.5])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (math.nan,)], "v double").repartition(3)
        want = np.quantile(values, probabilities)
        assert quantile.exact_quantiles(df, "v", probabilities) == pytest.approx(list(want), rel=1e-14, abs=1e-300)
    assert quantile.exact_quantiles(df.limit(0), "v", (0.5,)) == [None]


def newton(x, y, ridge):
    """Logistic regression by plain numpy."""
    x = np.column_stack((np.ones(len(x)), x))
    pull, beta = np.array([0.0] + [ridge] * (x.shape[1] - 1)), np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * beta)
    return beta


@pytest.mark.parametrize("ridge", [0.0, 2.0])
def test_logistic_against_numpy(spark, ridge):
    rng = np.random.default_rng(4)
    x = np.column_stack((rng.normal(size=500), rng.integers(0, 2, 500), rng.exponential(size=500)))
    y = rng.random(500) < 1 / (1 + np.exp(-(x @ [1.5, -2.0, 0.5] - 0.3)))
    rows = [(bool(b), *map(float, r)) for b, r in zip(y, x)] + [(None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "good boolean, a double, b double, c double").repartition(3)
    fit = learn.fit_logistic(df, "good", {n: F.col(n) for n in "abc"}, ridge)
    assert fit.converged and list(fit.weights) == ["intercept", "a", "b", "c"]
    want = newton(x, y, ridge)
    assert list(fit.weights.values()) == pytest.approx(list(want), rel=1e-8)
    p = {(r.a, r.b): r.p for r in df.select("a", "b", fit.probability().alias("p")).collect()}
    assert p[(rows[0][1], rows[0][2])] == pytest.approx(1 / (1 + math.exp(-(want[0] + x[0] @ want[1:]))), rel=1e-8)


def test_logistic_without_a_solution(spark):
    df = spark.createDataFrame([(k > 5, float(k), 2.0 * k) for k in range(10)], "y boolean, a double, b double")
    with pytest.raises(ValueError, match="sums of others"):
        learn.fit_logistic(df, "y", {"a": F.col("a"), "b": F.col("b")})
    assert not learn.fit_logistic(df, "y", {"a": F.col("a")}, most_rounds=12).converged
    assert learn.fit_logistic(df, "y", {"a": F.col("a"), "b": F.col("b")}, ridge=0.1).converged
    with pytest.raises(ValueError, match="no row"):
        learn.fit_logistic(df.withColumn("y", F.lit(None).cast("boolean")), "y", {"a": F.col("a")})


def test_learned_signals_rank_items(spark):
    """Labels that contradict the shipped weights turn them round."""
    items = [("5 years of x", False)] * 8 + [("degree in y", True)] * 8 + [("responsible for z", True)] * 7 + [("responsible for w", False), ("other", False), ("other", True)]
    df = spark.createDataFrame(items, "text string, ok boolean")
    fit, signals = learn.learned_signals(df, "text", "ok", QUALIFICATION_SIGNALS)
    weights = dict(signals)
    assert fit.converged and weights[r"\d+\+?\s*years?"] < 0 < weights["responsible for"] and weights["degree|diploma|certificat"] > 0.2
    scored = {r.text: r.c for r in df.select("text", confidence("text", signals, 0.5).alias("c")).collect()}
    assert scored["5 years of x"] < scored["other"] < scored["degree in y"]


def tau(a, b):
    """Kendall's tau-b by all pairs."""
    x, y = np.sign(np.subtract.outer(a, a)), np.sign(np.subtract.outer(b, b))
    return float((x * y).sum() / math.sqrt((x != 0).sum()) / math.sqrt((y != 0).sum()))


@pytest.mark.parametrize("rows", [7, 100_000])
def test_kendall_against_all_pairs(spark, monkeypatch, rows):
    """One range and many, ties in one or both, a value that most rows have."""
    monkeypatch.setattr(agreement, "RANGE_ROWS", rows)
    monkeypatch.setattr(agreement, "MOST_RANGES", 9)
    rng = np.random.default_rng(6)
    x = rng.normal(size=400)
    for a, b in ((x, x + rng.normal(size=400)), (np.round(x, 1), np.round(-x + rng.normal(size=400))), (np.where(rng.random(400) < 0.6, 0.0, x), rng.integers(0, 3, 400) * 1.0),
                 (x[:80], x[:80]), (x[:80], -x[:80]), (x[:2], x[:2])):
        df = spark.createDataFrame([*zip(a.tolist(), b.tolist()), (None, 1.0), (math.nan, 2.0)], "a double, b double").repartition(3)
        assert agreement.kendall_tau(df, "a", "b") == pytest.approx(tau(a, b), abs=1e-12)
    assert agreement.kendall_tau(df.withColumn("b", F.lit(1.0)), "a", "b") is None and agreement.kendall_tau(df.limit(0), "a", "b") is None


def test_inversions():
    rng = np.random.default_rng(8)
    v, w = rng.integers(0, 40, 500).astype(float), rng.integers(1, 5, 500)
    assert agreement.inversions(v, w) == sum(int(w[i] * w[j]) for i in range(500) for j in range(i + 1, 500) if v[i] > v[j])


def test_weights_that_agree(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    rows = [(*map(float, r), float(t)) for r, t in zip(x, x @ [0.75, 0.25, 0.0])]
    df = spark.createDataFrame(rows, "a double, b double, c double, truth double")
    local = lambda d, s, t: tau(*np.array([tuple(r) for r in d.select(s, t).collect()]).T)
    weights, value = agreement.search_weights(df, ["a", "b", "c"], "truth", objective=local)
    assert value > 0.98 and abs(weights["a"] - 0.75) < 0.1 and weights["c"] < 0.1 and sum(weights.values()) == pytest.approx(1.0)
