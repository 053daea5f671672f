import math
import random

import numpy as np
import pytest

from fitlens.llm import whitening
from fitlens.llm.queries import op12_multiplicity_whitening

from tests.llm.conftest import DATA

NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(rows, components=32, distinct=False):
    """Rows of plain numpy and Python integers, without whitened, and the whitened vectors by row."""
    d = max((len(v) for _, v in rows if v is not None), default=0)
    kept = [(k, [math.floor(64 * c) + 1_000_000 for c in v]) for k, v in rows
            if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = [x for _, x in kept]
    fit = [list(x) for x in sorted(set(map(tuple, fit)))] if distinct else fit
    n = len(fit)
    sums = [sum(x[i] for x in fit) for i in range(d)]
    off = np.array([[float(n * x[i] - sums[i]) / n for i in range(d)] for x in fit])
    values, axes = np.linalg.eigh(off.T @ off / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    return [(key, n, sum((n * v - s) ** 2 for v, s in zip(x, sums)),
             np.array([float(n * v - s) / n for v, s in zip(x, sums)]) @ axes[:, :k] / np.sqrt(values[:k])) for key, x in kept], (
                values[:k] / values.sum()).tolist()


def held(got, rows, components=32, distinct=False):
    want, explained = brute(rows, components, distinct)
    k = len(explained)
    assert len(got) == len(want) * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation, r.n), []).append(r)
    signs = None
    for key, n, deviation, white in want:
        own = by[(key, deviation, n)]
        own = sorted(own, key=lambda r: r.component)[:: len(own) // k]
        assert [r.component for r in own] == list(range(1, k + 1))
        assert np.allclose([r.explained for r in own], explained, rtol=1e-9)
        z = np.array([r.whitened for r in own])
        if signs is None and np.abs(white).min() > 1e-6:
            signs = np.sign(z * white)
        assert np.allclose(np.abs(z), np.abs(white), atol=1e-7) and (signs is None or np.allclose(z, signs * white, atol=1e-7))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame([(k, v, 1, "a") for k, v in rows], f"vec_id long, embedding array<{kind}>, n long, _group string").repartition(3)


@pytest.fixture
def some():
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1 + i) for i in range(6)]) for k in range(150)]
    return rows + [(1000 + k, rows[3][1]) for k in range(90)] + [(2000 + k, rows[k][1]) for k in range(9)]


@pytest.mark.parametrize("parts", [1, 4096])
@pytest.mark.parametrize("weigh", ["rows", "one"])
def test_multiplicities(spark, some, weigh, parts, monkeypatch):
    """A vector with a third of the rows, dealt out or not; weights by rows and one each."""
    monkeypatch.setattr(whitening, "PARTS", parts)
    got = whitening.whiten(vectors_of(spark, some, "double"), weigh=weigh).collect()
    held(got, some, distinct=weigh == "one")


def test_dropped_and_odd_rows(spark, some):
    odd = [(1, None), (2, [None] + [1.0] * 5), (3, [float("nan")] * 6), (4, [float("inf")] + [0.0] * 5), (5, []), (6, [1.0, 2.0]),
           (None, [0.5] * 6), (7, [0.0] * 6), (7, [0.0] * 6), (8, [-0.001] * 6)]
    got = whitening.whiten(vectors_of(spark, some + odd, "double"), components=4)
    assert got.columns == NAMES
    held(got.collect(), some + odd, components=4)


def test_large_entries_stay_exact(spark, some):
    """A large common part costs no digits; sums above a long are null, and sizes beyond 2^52 end there."""
    far = [(k, [c + 1e9 for c in v]) for k, v in some]
    held(whitening.whiten(vectors_of(spark, far, "double")).collect(), far)
    huge = [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [0.0, 2.0])]
    got = whitening.whiten(vectors_of(spark, huge, "double")).collect()
    assert [r.deviation for r in sorted(got)] == [None, None, 36864]  # the second component is rounding only


def test_nothing_to_whiten(spark):
    assert whitening.whiten(vectors_of(spark, [])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, [None])])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    line = whitening.whiten(vectors_of(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(9)])).collect()
    assert len(line) == 9 and {r.component for r in line} == {1}
    with pytest.raises(ValueError):
        whitening.whiten(vectors_of(spark, []), weigh="all")


def test_whole_table(spark):
    got = op12_multiplicity_whitening(spark, DATA)
    assert got.columns == NAMES
    held(got.collect(), [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()])
