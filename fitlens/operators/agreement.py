"""How far two orders of the same rows agree, and weights that agree best with a known order."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlens.operators.evaluate import composite
from fitlens.operators.rows import stored

#: Different pairs of values that a range is laid out for, and the most ranges.
RANGE_ROWS, MOST_RANGES = 100_000, 1000


def inversions(values: np.ndarray, weights: np.ndarray) -> int:
    """Sum of the products of the weights of all pairs whose first value is the larger one."""
    if len(values) <= 64:
        falls = np.triu(values[:, None] > values[None, :], 1)
        return int(weights @ falls @ weights)
    half = len(values) // 2
    order = np.argsort(values[:half], kind="stable")
    below = np.concatenate(([0], np.cumsum(weights[:half][order])))
    larger = below[-1] - below[np.searchsorted(values[:half][order], values[half:], side="right")]
    return int(larger @ weights[half:]) + inversions(values[:half], weights[:half]) + inversions(values[half:], weights[half:])


def _falls(rows: DataFrame, value: str) -> int:
    """Inversions within each partition of rows (``value, w``) that lie in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, weights = [np.zeros(0)], [np.zeros(0, np.int64)]
        for batch in batches:
            values.append(batch.column(value).to_numpy())
            weights.append(batch.column("w").to_numpy())
        found = inversions(np.concatenate(values), np.concatenate(weights))
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64())], ["n"])

    return rows.select(value, "w").mapInArrow(run, "n long").agg(F.sum(F.col("n").cast("decimal(38,0)"))).first()[0] or 0


def kendall_tau(df: DataFrame, a: str, b: str) -> float | None:
    """Kendall's tau-b of two columns, exact, with ties; None where one has a single value. Rows with a
    null or NaN do not count.

    Discordant pairs are the inversions of ``b`` in the order of ``a``. They are counted within ranges of
    that order; between ranges, by how many rows each has in each range of ``b``; and for the rest, which
    share a range of ``b``, within that range. Equal pairs of values count once with their number, so
    a value that most rows have is one row. No order is counted in one task, and what comes to the
    driver is one number for each pair of ranges, at most a million."""
    pair = stored(df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter(
        "a is not null and b is not null and not isnan(a) and not isnan(b)").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")))
    square = lambda c: F.sum(F.col(c).cast("decimal(38,0)") * (F.col(c) - 1))
    tied = lambda *by: pair.groupBy(*by).agg(F.sum("w").alias("t")).agg(square("t")).first()[0] or 0
    n, rows = pair.agg(F.coalesce(F.sum("w"), F.lit(0)), F.count(F.lit(1))).first()
    every, same_a, same_b, same = (int(x) // 2 for x in (n * (n - 1), tied("a"), tied("b"), tied("a", "b")))
    if same_a == every or same_b == every:
        return None
    ranges = max(1, min(MOST_RANGES, math.ceil(rows / RANGE_ROWS)))
    # The ranges are stored as they are, so that later steps and retries see the same ones.
    first = stored(pair.repartitionByRange(ranges, "a", "b").sortWithinPartitions("a", "b").withColumn("p", F.spark_partition_id()))
    shared = first.groupBy("p", "b").agg(F.sum("w").alias("w"))
    second = stored(shared.repartitionByRange(ranges, "b").sortWithinPartitions("p", "b").withColumn("c", F.spark_partition_id()))
    falls = int(_falls(first, "b")) + int(_falls(second, "b"))
    counted = second.groupBy("p", "c").agg(F.sum("w").alias("w")).toArrow()
    table = np.zeros((ranges, ranges), dtype=object)
    for p, c, w in zip(*(counted[x].to_pylist() for x in ("p", "c", "w"))):
        table[p, c] += w
    # Of an earlier range of ``a`` and a later one of ``b``: rows above and to the right.
    above = np.cumsum(table, axis=0) - table
    right = np.cumsum(above[:, ::-1], axis=1)[:, ::-1] - above
    falls += int((table * right).sum())
    agree = every - same_a - same_b + same - 2 * falls
    return agree / math.sqrt(every - same_a) / math.sqrt(every - same_b)


def search_weights(scores: DataFrame, components: Sequence[str], truth: str, step: float = 0.25, least_step: float = 0.05,
                   objective: Callable[[DataFrame, str, str], float | None] = kendall_tau) -> tuple[dict[str, float], float]:
    """Weights of the components, in all 1, whose composite agrees best with ``truth`` (larger is better),
    and how far it does.

    A search by coordinates over the simplex: from the best of the corners and the middle, ``step`` of the
    weight goes from one component to another as long as that helps; then the step is halved, down to
    ``least_step``. Each point is judged once. A search of this kind can end at a local best."""
    held = stored(scores.select(truth, *components))
    known: dict[tuple, float] = {}

    def judged(point: tuple) -> float:
        if point not in known:
            weights: Mapping[str, float] = dict(zip(components, point))
            value = objective(held.select(truth, composite(weights).alias("_score")), "_score", truth)
            known[point] = -2.0 if value is None else value
        return known[point]

    k = len(components)
    corners = [tuple(1.0 if i == j else 0.0 for i in range(k)) for j in range(k)]
    best = max([*corners, tuple(round(1 / k, 6) for _ in range(k))], key=judged)
    while step >= least_step:
        moved = []
        for i in range(k):
            for j in range(k):
                if i != j and best[i] > 0:
                    part = min(step, best[i])
                    moved.append(tuple(round(x + part * ((m == j) - (m == i)), 9) for m, x in enumerate(best)))
        after = max(moved, key=judged, default=best)
        if judged(after) > judged(best) + 1e-12:
            best = after
        else:
            step /= 2
    return dict(zip(components, best)), judged(best)
