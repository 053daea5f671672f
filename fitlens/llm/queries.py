"""The operators of this subpackage applied to whole tables, and SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlens.llm import langid, lines, middle, mixing, outliers, overlap, pages, simhash, suffixes, tiling, tokens, urls, whitening
from fitlens.llm.common import table


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    """Path of a public vocabulary file of the machine; none is part of this repository."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_style_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_main_text(table(spark, sf_dir, "pages"))


def op2_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = table(spark, sf_dir, "pages", "page_id", "url")
    return urls.judge(site, urls.labelled_urls(site, table(spark, sf_dir, "labels")))


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_piece_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"), vocabulary())


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_verdicts(table(spark, sf_dir, "documents")).drop("distance")


def op8_longest_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.without_repeats(table(spark, sf_dir, "documents"), keep_first=False)
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op10_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_duplicates(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_multiplicity_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_count_rtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.similar_sets(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_style_tree_text": (op1_style_tree_text, None),
    "op2_vantage_simhash": (op2_vantage_simhash, None),
    "op3_boosted_url_filter": (op3_boosted_url_filter, None),
    "op4_string_tiling": (op4_string_tiling, None),
    "op5_piece_languages": (op5_piece_languages, None),
    "op6_mix_sources": (op6_mix_sources, mixing.SQL),
    "op7_robust_outliers": (op7_robust_outliers, None),
    "op8_longest_previous_factors": (op8_longest_previous_factors, None),
    "op9_token_counts": (op9_token_counts, None),
    "op10_segment_line_dedup": (op10_segment_line_dedup, None),
    "op11_fill_in_middle": (op11_fill_in_middle, middle.SQL),
    "op12_multiplicity_whitening": (op12_multiplicity_whitening, None),
    "op13_count_rtree_join": (op13_count_rtree_join, None),
}
