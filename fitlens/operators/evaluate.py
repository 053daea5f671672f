"""Comparing predictions with labels, parsers with each other, weights with a ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlens.functions.text import _as_column
from fitlens.lexicon import FIT_THRESHOLD, validate_weights
from fitlens.functions.sections import Parser, parse_description
from fitlens.lexicon import DEFAULT_LEXICON, Lexicon
from fitlens.operators.quantile import exact_quantiles
from fitlens.operators.rank import global_rank
from fitlens.operators.rows import stored


def label_metrics(df: DataFrame, truth: Column | str, predicted: Column | str,
                  by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall and F1 of two boolean columns. A measure with an
    empty denominator is 0.0."""
    t, p = _as_column(truth), _as_column(predicted)
    counts = df.groupBy(*by).agg(
        F.sum(F.when(t & p, 1).otherwise(0)).alias("tp"),
        F.sum(F.when(~t & p, 1).otherwise(0)).alias("fp"),
        F.sum(F.when(t & ~p, 1).otherwise(0)).alias("fn"),
        F.sum(F.when(~t & ~p, 1).otherwise(0)).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
    )


def confusion(df: DataFrame, truth: Column | str, predicted: Column | str) -> DataFrame:
    return df.groupBy(_as_column(truth).alias("truth"), _as_column(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n_rows"))


def compare_parsers(df: DataFrame, text: str, key: str, a: Parser, b: Parser,
                    lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Per row the item counts and summary lengths of two parsers, and their differences. Both
    parse in one pass over the rows, without a join."""
    counts = ("required", "bonus", "duties", "summary_chars")
    for side, parser in (("a", a), ("b", b)):
        parsed = parse_description(df, text, lexicon, parser)
        values = (F.size("qualifications_required"), F.size("qualifications_bonus"), F.size("responsibilities"), F.length("summary"))
        df = parsed.select(*df.columns, *[v.alias(f"{c}_{side}") for c, v in zip(counts, values)])
    return df.select(key, *[c for n in counts for c in (
        F.col(f"{n}_a"), F.col(f"{n}_b"), (F.col(f"{n}_b") - F.col(f"{n}_a")).alias(f"{n}_delta"))])


def parse_quality(parsed: DataFrame) -> DataFrame:
    """Section detection rate and average items per posting."""
    quals = F.size("qualifications_required") + F.size("qualifications_bonus")
    resps = F.size("responsibilities")
    found = F.when((quals > 0) | (resps > 0), 1.0).otherwise(0.0)
    return parsed.agg(
        F.count(F.lit(1)).alias("n_postings"), F.avg(found).alias("detection_rate"),
        F.avg(quals).alias("avg_qualifications"), F.avg(resps).alias("avg_responsibilities"))


def ranking_quality(scored: DataFrame, score: str = "composite_score",
                    matches: str = "skill_match_count") -> DataFrame:
    """Spread of the scores with their exact quartiles, and their correlation with the skill matches."""
    narrow = stored(scored.select(F.col(score).alias("s"), F.col(matches).cast("double").alias("m")))
    quartiles = exact_quantiles(narrow, "s", (0.25, 0.5, 0.75))
    s = F.col("s")
    return narrow.agg(
        F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.avg(s).alias("avg_score"),
        F.stddev_samp(s).alias("sd_score"), F.corr("m", s).alias("skill_correlation")).select(
        "*", F.array(*[F.lit(q).cast("double") for q in quartiles]).alias("quartiles"))


def composite(weights: Mapping[str, float] | None = None) -> Column:
    """Weighted sum of component columns; by default the overall similarity alone."""
    weights = validate_weights(weights or {"overall_similarity": 1.0})
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name) * F.lit(float(weight))
    return total


def good_fit(score: Column | str, threshold: float = FIT_THRESHOLD) -> Column:
    return _as_column(score) >= F.lit(threshold)


def weight_grid(scores: DataFrame, grid: Sequence[Mapping[str, float]], truth_rank: str,
                id_col: str = "job_id") -> DataFrame:
    """Rank correlation of each weighting with a known ranking, best first.

    ``grid`` is a parameter list. Every row gets its composite per grid point in one narrow
    step; ranks per point come from the distributed rank, so no point is ranked in one task."""
    for weights in grid:
        validate_weights(weights)
    points = F.array(*[
        F.struct(F.lit(i).alias("point"), composite(w).alias("score")) for i, w in enumerate(grid)])
    long = scores.select(id_col, truth_rank, F.explode(points).alias("_p")).select(
        id_col, truth_rank, "_p.point", "_p.score")
    ranked = global_rank(long, [F.col("score").desc(), F.col(id_col)], group=["point"])
    return ranked.groupBy("point").agg(
        F.corr(F.col("rank").cast("double"), F.col(truth_rank).cast("double")).alias("rank_correlation")
    ).orderBy(F.desc_nulls_last("rank_correlation"), "point")
