"""Exports of a ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of the summary, in order.
SUMMARY_COLUMNS = (
    "rank", "composite_score", "company", "job_title", "location", "overall_similarity",
    "skill_match_count", "skill_gap_count", "job_url", "date_posted",
)


def summary(scored: DataFrame) -> DataFrame:
    return scored.select(*SUMMARY_COLUMNS)


def write_summary_csv(scored: DataFrame, path: str, enabled: bool = True) -> None:
    """The summary as CSV with a header, in rank order, one file per partition."""
    if enabled:
        summary(scored).orderBy("rank").write.mode("overwrite").option("header", True).csv(path)


def write_detailed_json(scored: DataFrame, path: str, export_date: str, enabled: bool = True) -> None:
    """All columns with nested matches, one JSON object per line. The two facts about the
    export itself are columns of every row, so that the file stays splittable."""
    if enabled:
        (scored.withColumn("export_date", F.lit(export_date)).orderBy("rank")
         .write.mode("overwrite").option("ignoreNullFields", False).json(path))


def encode_nested(df: DataFrame, columns) -> DataFrame:
    """Nested columns as JSON text."""
    return df.withColumns({c: F.to_json(c) for c in columns})


def decode_nested(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """JSON text columns back to the given types."""
    return df.withColumns({c: F.from_json(c, t) for c, t in columns.items()})
