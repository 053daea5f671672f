"""The training-corpus pipeline: five stages, each over all that the one before it kept.

Every stage is a function of (session, documents, folder of the tables). Its result is written as
Parquet and read back as the documents of the next. All but the last return the columns of
``documents``; the last returns how much of each document the mix takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fitlens.llm import lines, mixing, outliers, similar, tiling
from fitlens.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return outliers.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that occur earlier in the corpus, up to two edits; ``n_chars`` follows. A
    document without a line left goes: all of it is in earlier ones."""
    return lines.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with Jaccard 0.8 or more over five-word shingles. Pairs come
    from the vantage-point search of SimHash fingerprints, then from shared shingles; whole sets decide."""
    return similar.one_of_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item has leaked."""
    return tiling.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
]

#: Edit joins, bit distances and string tiling are not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
