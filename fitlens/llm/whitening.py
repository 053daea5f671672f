"""Embeddings whitened over their covariance, every distinct vector once.

Vectors become whole numbers, and equal ones are grouped with their multiplicity. The mean is exact.
The covariance is a matrix product of the centred distinct vectors, weighted by multiplicity or
by one, summed up over the tasks; its components are found on the driver, whose share is a square
of the dimension and does not grow with the rows. Then every distinct vector is whitened once
and joined back to its rows."""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlens.llm.common import written

SCALE, COMPONENTS = 64, 32
#: Largest size of a scaled entry; larger ones count as this, so that all stay whole numbers.
LARGEST = 1 << 52
#: A vector with more than this part of the rows is dealt out over several tasks. There are
#: fewer such vectors than that, so the table of them is bounded.
PARTS = 4096
#: Numbers of a block of vectors that are computed at once.
BLOCK = 1 << 20


def _packed(values: np.ndarray) -> list[bytes]:
    """Every row in the narrowest whole numbers that hold it; equal rows give equal bytes."""
    n, d = values.shape
    low, high = values.min(1), values.max(1)
    width, out = np.full(n, 8), np.empty(n, object)
    for w in (4, 2, 1):
        width[(low >= -(1 << 8 * w - 1)) & (high < 1 << 8 * w - 1)] = w
    for w in (1, 2, 4, 8):
        own = np.flatnonzero(width == w)
        rows = np.ascontiguousarray(values[own].astype(f"<i{w}")).view(f"V{d * w}").ravel().tolist()
        out[own] = np.fromiter(rows, object, len(rows))
    return out.tolist()


def _unpacked(packed: list[bytes], d: int) -> np.ndarray:
    out = np.empty((len(packed), d), np.int64)
    size = np.fromiter(map(len, packed), np.int64, len(packed))
    for w in (1, 2, 4, 8):
        own = np.flatnonzero(size == d * w)
        out[own] = np.frombuffer(b"".join(packed[i] for i in own), f"<i{w}").reshape(-1, d)
    return out


def _points(vectors: DataFrame, key: str, vector: str, scale: int, d: int) -> DataFrame:
    """``key, _group, _y`` of every row whose vector is whole: ``_y`` holds the scaled entries, rounded
    down, and ``_group`` a digest of them."""
    kind = vectors.schema[key].dataType.simpleString()
    step = max(1, BLOCK // d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(vector)
            fits = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(-1)) == d)
            for begin in range(0, len(fits), step):
                own = fits[begin:begin + step]
                values = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                whole = np.isfinite(values).all(1)
                own, values = own[whole], values[whole]
                if not len(own):
                    continue
                with np.errstate(over="ignore"):
                    y = np.clip(np.floor(values * scale), -LARGEST, LARGEST).astype(np.int64)
                packed = _packed(y)
                digests = [hashlib.blake2b(b, digest_size=16).digest() for b in packed]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(own)), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())],
                    [key, "_group", "_y"])

    narrow = vectors.select(key, F.col(vector).cast("array<double>").alias(vector))
    return narrow.mapInArrow(run, f"`{key}` {kind}, _group binary, _y binary")


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with their vectors and weights."""
    step = max(1, BLOCK // d)
    for batch in batches:
        for begin in range(0, batch.num_rows, step):
            part = batch.slice(begin, step)
            yield part, _unpacked(part.column("_y").to_pylist(), d), part.column("_w").to_numpy()


def _totals(groups: DataFrame, d: int) -> tuple[list[int], int]:
    """Exact sums of all entries, and of the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (d + 1)
        for _, y, w in _blocks(batches, d):
            y = np.column_stack((y, np.ones(len(y), np.int64)))
            if float(np.abs(y).max()) * float(w.sum()) >= 2.0 ** 62:
                y = y.astype(object)
            total = [a + int(b) for a, b in zip(total, w @ y)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d + 1), pa.int32()), pa.array(map(decimal.Decimal, total), pa.decimal128(38, 0))], ["i", "total"])

    summed = groups.mapInArrow(run, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total"))
    total = {r["i"]: int(r["total"]) for r in summed.collect()}
    return [total.get(i, 0) for i in range(d)], total.get(d, 0)


def _gram(groups: DataFrame, d: int, k: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Weighted sum of ``of(y)`` (``k`` numbers, and a one behind them) times itself, over all vectors.
    Every task gives ``k + 1`` rows; those of one number are added up in one task each."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for _, y, w in _blocks(batches, d):
            z = np.column_stack((of(y), np.ones(len(y))))
            total += (z * w[:, None]).T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(list(total))], ["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row")):
                rows[i] = rows.get(i, 0.0) + row.values.to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int32()), pa.array(list(rows.values()), pa.list_(pa.float64()))], ["i", "row"])

    schema = "i int, row array<double>"
    summed = groups.mapInArrow(multiply, schema).repartition("i").mapInArrow(add, schema).toArrow()
    out = np.zeros((k + 1, k + 1))
    for i, row in zip(summed.column("i").to_pylist(), summed.column("row").to_pylist()):
        out[i] += row
    return out


def _centring(total: list[int], n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Function from whole vectors to their distances from the mean: the whole part of the mean is taken
    off as a whole number, so that no digit is lost to a large common part."""
    whole = np.array([t // n for t in total], np.int64)
    rest = np.array([t % n / n for t in total])
    return lambda y: (y - whole).astype(np.float64) - rest


def _deviations(y: np.ndarray, total: list[int], n: int) -> list[int | None]:
    """Sum of the squares of ``n * y - total`` of every row, exact; None above the largest long."""
    whole, rest = np.array([t // n for t in total], np.int64), np.array([t % n for t in total], np.int64)
    off = y - whole
    most = (float(np.abs(off).max()) + 1.0) * n
    if most * most * y.shape[1] < 2.0 ** 62:
        off = n * off - rest
        return np.einsum("ij,ij->i", off, off).tolist()
    off = n * off.astype(object) - rest.astype(object)
    return [v if v < 1 << 63 else None for v in (off * off).sum(1)]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
           components: int = COMPONENTS, weigh: str = "rows") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for every whole vector and
    component, of ``vectors`` (other columns are ignored).

    An entry c counts as ``floor(scale * c)``; a constant added to every entry, which moves all vectors
    and their mean alike, would change no result and no digit. A row goes if its vector is null, has a null or
    non-finite entry, or is shorter than the longest one, whose missing entries count as null; a row
    without key stays. ``weigh="rows"`` fits on all remaining rows, ``"one"`` on each distinct vector
    once; ``n`` is the size of the fit, and covariances divide by it.

    Components are numbered from 1 by falling eigenvalue, ties in the order of the decomposition, and
    the largest entry of each is positive. One whose eigenvalue is zero but for rounding has no
    whitened value and is left out; so is every one if all vectors are equal, or of an empty
    table. ``deviation`` is null above the largest long; a scaled entry beyond 2^52 counts as
    that. ``identity_error`` is measured over all vectors."""
    if weigh not in ("rows", "one"):
        raise ValueError(f"weigh is rows or one, not {weigh}")
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = vectors.agg(F.max(F.size(vector))).first()[0] or 0
    if d < 1:
        return spark.createDataFrame([], schema)
    rows = written(_points(vectors, key, vector, scale, d))
    counted = rows.groupBy("_group", "_y").agg(F.count(F.lit(1)).alias("_n"))
    groups = written(counted.select("*", (F.col("_n") if weigh == "rows" else F.lit(1).cast("long")).alias("_w")))
    total, n = _totals(groups, d)
    if not n:
        return spark.createDataFrame([], schema)
    centred = _centring(total, n)
    covariance = _gram(groups, d, d, centred)[:d, :d] / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > d * np.finfo(float).eps * max(values[0], 0.0)).sum()) if values[0] > 0 else 0)
    if not k:
        return spark.createDataFrame([], schema)
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(d)])
    turn = axes[:, :k] / np.sqrt(values[:k])
    gram = _gram(groups, d, k, lambda y: centred(y) @ turn) / n
    mean = gram[k, :k]
    error = float(np.abs(gram[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())
    explained = (values[:k] / np.trace(covariance)).tolist()

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, y, _ in _blocks(batches, d):
            yield pa.RecordBatch.from_arrays(
                [part.column("_group"), part.column("_n"), pa.array(_deviations(y, total, n), pa.int64()),
                 pa.array(list(centred(y) @ turn), pa.list_(pa.float64()))], ["_group", "_n", "deviation", "_z"])

    white = written(groups.mapInArrow(transform, "_group binary, _n long, deviation long, _z array<double>"))
    # A frequent vector's rows are dealt over several tasks, and its result is copied to each.
    part = max(1, -(-int(groups.agg(F.sum("_n")).first()[0]) // PARTS))
    parts = F.ceil(F.col("_n") / F.lit(part)).cast("long")
    frequent = F.broadcast(white.filter(F.col("_n") > part).select("_group", parts.alias("_parts")))
    deal = F.pmod(F.xxhash64(key) + F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1).cast("long")))
    dealt = rows.select(F.col(key), "_group").join(frequent, "_group", "left").select(key, "_group", deal.alias("_part"))
    copies = white.select("_group", "deviation", "_z", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)) - 1)).alias("_part"))
    joined = dealt.join(copies, ["_group", "_part"]).select(F.col(key), "deviation", F.posexplode("_z").alias("_at", "whitened"))
    share = F.element_at(F.array(*[F.lit(e) for e in explained]), F.col("_at") + 1)
    return joined.select(F.col(key), (F.col("_at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                         "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
