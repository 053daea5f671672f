"""Table constraints as queries, and job statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LENGTHS = {"job_title": 500, "company": 500, "location": 500, "job_url": 1000,
               "salary_range": 200, "job_type": 100, "source": 100}
REQUIRED = ("job_title", "company", "job_description")


def unique_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose reference points nowhere."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.join(keys, child_key, "left_anti")


def constraint_violations(df: DataFrame, required: Sequence[str] = REQUIRED,
                          lengths: Mapping[str, int] = MAX_LENGTHS) -> DataFrame:
    """Rows that break a NOT NULL or length rule, one row per broken rule with ``reason``."""
    reasons = [F.when(F.col(c).isNull(), F.lit(f"{c}:null")) for c in required]
    reasons += [F.when(F.length(c) > n, F.lit(f"{c}:longer_than_{n}")) for c, n in lengths.items()
                if c in df.columns]
    return df.withColumn("reason", F.explode(F.array_compact(F.array(*reasons))))


def status_counts(df: DataFrame, processed: Column) -> DataFrame:
    """total, processed and unprocessed rows; an empty table gives 0 and two nulls."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(processed, 1).otherwise(0)).alias("processed"),
        F.sum(F.when(~processed, 1).otherwise(0)).alias("unprocessed"))


def outcome_rollup(df: DataFrame, by: str = "file", outcome: str = "outcome",
                   outcomes: Sequence[str] = ("inserted", "duplicates", "errors")) -> DataFrame:
    """Counts per file and outcome and, with a null file, the grand total."""
    counts = [F.count(F.when(F.col(outcome) == o, 1)).alias(o) for o in outcomes]
    return df.rollup(by).agg(F.grouping(by).cast("int").alias("is_total"), *counts)


def outcome_counts(df: DataFrame, outcome: str = "outcome",
                   outcomes: Sequence[str] = ("processed", "errors")) -> DataFrame:
    return df.agg(*[F.count(F.when(F.col(outcome) == o, 1)).alias(o) for o in outcomes])
