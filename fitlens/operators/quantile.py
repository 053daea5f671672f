"""Exact quantiles of a column of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlens.operators.rows import stored

#: Cells that the interval of a wanted rank is cut into, and values of a cell that are sorted at once.
CELLS, FEW = 1024, 10_000


def _cell(low: float, high: float) -> Column:
    # Halves where the difference of the ends is too large for a double.
    part = 1.0 if math.isfinite(high - low) else 0.5
    share = (F.col("x") * part - F.lit(low * part)) / F.lit(high * part - low * part)
    return F.least(F.lit(CELLS - 1), F.floor(share * CELLS).cast("int"))


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbouring values; None for no values. Nulls
    and NaN are no values.

    No value is sorted among all others. The interval of each wanted rank, at first from the least to the
    largest value, is cut into cells whose values are counted; the cell that the rank is in gives the
    next interval, from its least to its largest value, until these are equal or few are left. The
    two ends never share a cell, so each round narrows the interval, however the values lie. A
    round is one aggregate; what leaves a task does not grow with the rows."""
    values = stored(df.select(F.col(column).cast("double").alias("x")).filter("x is not null and not isnan(x)"))
    n, least, most = values.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(probabilities)
    places = [p * (n - 1) for p in probabilities]
    # Rank to its interval: values below it, its ends, and how many values it holds.
    open_ = {r: (0, least, most, n) for r in {f(h) for h in places for f in (math.floor, math.ceil)}}
    found: dict[int, float] = {}
    while open_:
        for r, (below, low, high, held) in list(open_.items()):
            if low == high:
                found[r] = low
                del open_[r]
            elif held <= FEW:
                own = values.filter(F.col("x").between(low, high)).toArrow()["x"].to_numpy()
                found[r] = float(np.partition(own, r - below)[r - below])
                del open_[r]
        if not open_:
            break
        intervals = sorted({i for i in open_.values()})
        cell = [F.when(F.col("x").between(low, high), _cell(low, high)) for _, low, high, _ in intervals]
        cells = F.array(*[F.struct(F.lit(k).alias("k"), c.alias("cell")) for k, c in enumerate(cell)])
        counted = values.select("x", F.explode(F.filter(cells, lambda c: c["cell"].isNotNull())).alias("c")).groupBy("c.k", "c.cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        by: dict[int, list] = {}
        for row in sorted(counted.collect(), key=lambda row: (row["k"], row["cell"])):
            by.setdefault(row["k"], []).append(row)
        for r, interval in open_.items():
            below = interval[0]
            for row in by[intervals.index(interval)]:
                if r < below + row["n"]:
                    open_[r] = (below, row["low"], row["high"], row["n"])
                    break
                below += row["n"]
    out = []
    for h in places:
        low, high = found[math.floor(h)], found[math.ceil(h)]
        out.append(low if low == high else low + (high - low) * (h - math.floor(h)))
    return out
