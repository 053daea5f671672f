"""Mixing sources to target weights by weighted fair queueing. DataFrame and SQL functions only.

Every source is a queue of its documents in shuffled order, served up to three times over. A
copy of a document gets the virtual time at which a fair server would finish it: the words its
source has sent up to and including it, divided by the source's target. All copies are ordered
by that time, and the mix is cut where the budget of words is used up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitlens.llm.common import n_words, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Bins per unit of virtual time in each of the two passes that narrow down the cut, and the
#: most bins of the first pass (later times share the last one).
BINS, LAST_BIN = 4096, 1 << 16


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Weights go round the sources in code point order, null last. A target is ``weight * level``
    but at most ``repeats`` times the source; the level makes the targets sum to all sizes.
    Sorted by ``repeats * size / weight``, the capped sources are a prefix, so the level is read
    off running sums. One row per source, so the windows see as many rows as there are sources."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.array(*[F.lit(x) for x in weights])[turn]
    full = (F.lit(repeats) * F.col("source_size")).cast("double")
    rows = sizes.withColumn("w", w.cast("long")).withColumn("ratio", full / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    capped = F.coalesce(F.sum(F.lit(repeats) * F.col("source_size")).over(before), F.lit(0))
    w_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) - capped).cast("double") / w_left.cast("double")
    rows = rows.withColumn("level", level).withColumn("pos", F.row_number().over(order))
    chosen = F.min_by("level", F.when(F.col("ratio") >= F.col("level"), F.col("pos"))).over(everything)
    return rows.select("source", "source_size",
                       F.least(full, F.col("w").cast("double") * chosen).alias("target"))


def _finish(copy: int) -> Column:
    """Virtual finish time of the given copy (0, 1, ...) of a document."""
    sent = F.lit(copy) * F.col("source_size") + F.col("upto")
    return F.when(F.col("size") > 0, sent.cast("double") / F.col("target"))


def _cut(copies: DataFrame, budget: int) -> tuple[float, int] | None:
    """The last ``(finish, turn)`` within the budget, ``(-1.0, 0)`` if there is none, None if
    all copies fit. Two rounds of binning leave the exact running sum with a few rows only."""
    base, width = 0, 1.0 / BINS
    left = copies.withColumn("bin", F.least(F.floor(F.col("finish") * BINS), F.lit(LAST_BIN)))
    for step in (0, 1):
        bins = left.groupBy("bin").agg(F.sum("size").alias("n"))
        upto = bins.withColumn("upto", F.sum("n").over(Window.orderBy("bin")) + base)
        at = upto.filter(F.col("upto") > budget).orderBy("bin").limit(1).collect()
        if not at:
            return None
        at = at[0]
        base = at["upto"] - at["n"]
        left = left.filter(F.col("bin") == at["bin"])
        if step == 0:
            low = at["bin"] * width
            left = left.withColumn("bin", F.floor((F.col("finish") - low) * BINS * BINS))
    order = Window.orderBy("finish", "turn")
    inside = left.withColumn("upto", F.sum("size").over(order) + base).filter(F.col("upto") <= budget)
    last = inside.orderBy(F.desc("finish"), F.desc("turn")).limit(1).collect()
    if last:
        return last[0]["finish"], last[0]["turn"]
    earlier = copies.filter(F.col("finish") < left.agg(F.min("finish")).first()[0])
    last = earlier.orderBy(F.desc("finish"), F.desc("turn")).limit(1).collect()
    return (last[0]["finish"], last[0]["turn"]) if last else (-1.0, 0)


def mix_sources(docs: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``docs``
    (``doc_id, text, source``; other columns are ignored).

    A document's place in its source is by md5 of its id, so reruns agree. Running sums are
    taken over 4,096 hash ranges of every source and added up over the ranges, so no task sees
    a whole source. A null text has size 0, a row of size 0 is taken 0 times; equal rows are
    queued one after the other; a null source is a source. No rows give no rows."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key")))
    sized = sized.withColumn("range", F.substring("key", 1, 3))
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("n"))
    by_range = Window.partitionBy("source").orderBy("range")
    ranges = ranges.select("source", "range", (F.sum("n").over(by_range) - F.col("n")).alias("before"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights, repeats).withColumn(
        "turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    starts = ranges.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        "r.source", "range", "before", "source_size", "target", "turn")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    placed = sized.withColumn("within", F.sum("size").over(inside)).alias("d").join(
        starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.range") == F.col("s.range")))
    placed = written(placed.select(
        "d.doc_id", "d.source", "size", "source_size", "target", "turn",
        (F.col("within") + F.col("before")).alias("upto")))
    copies = placed.filter("size > 0").select("size", "turn", F.explode(F.array(
        *[_finish(i) for i in range(repeats)])).alias("finish"))
    budget = sizes.agg(F.sum("source_size")).first()[0] or 0
    cut = _cut(copies, budget)
    times = F.lit(0)
    for i in range(repeats):
        inside = F.lit(True) if cut is None else (_finish(i) < cut[0]) | (
            (_finish(i) == cut[0]) & (F.col("turn") <= cut[1]))
        times = times + F.when((F.col("size") > 0) & inside, 1).otherwise(0)
    return placed.select("doc_id", "source", "size", "source_size", "target",
                         (F.col("size") * times).cast("long").alias("taken"))


SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS turn,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
r AS (SELECT *, (3 * source_size)::DOUBLE / w AS ratio FROM w),
l AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS pos,
             (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM r),
t AS (SELECT source, turn, source_size, least((3 * source_size)::DOUBLE, w::DOUBLE *
             (SELECT level FROM l WHERE ratio >= level ORDER BY pos LIMIT 1)) AS target FROM l),
p AS (SELECT d.doc_id, d.source, d.size, t.turn, t.source_size, t.target, row_number() OVER () AS rid,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT rid, size, turn, (i * source_size + upto)::DOUBLE / target AS finish
      FROM p, (VALUES (0), (1), (2)) v(i) WHERE size > 0),
g AS (SELECT rid, size, sum(size) OVER (ORDER BY finish, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM c),
k AS (SELECT rid, sum(size) AS taken FROM g WHERE upto <= (SELECT sum(source_size) FROM s) GROUP BY rid)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM p LEFT JOIN k USING (rid)
"""
