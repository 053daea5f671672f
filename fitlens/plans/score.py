"""Scores, ranks and explanations of postings against profiles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlens.functions import tags
from fitlens.lexicon import DEFAULT_LEXICON, SECTION_TOP_N, Lexicon
from fitlens.operators.evaluate import composite
from fitlens.operators.match import explode_matches, match_profile
from fitlens.operators.rank import global_rank
from fitlens.operators.rows import small_side
from fitlens.sources.profile import technical_skills_text


#: Scores that a composite may weigh.
COMPONENTS = ("overall_similarity", "required_match", "responsibility_alignment", "bonus_match", "skill_match_ratio")


def full_vectors(job_embeddings: DataFrame) -> DataFrame:
    """``job_id, embedding`` of every posting with any vector: the full-description vector,
    null where only other sections have one.

    The vectors are not grouped: the few postings without a full description come from an
    anti join on the key column alone."""
    full = job_embeddings.filter("section = 'full_description'").select("job_id", "embedding")
    others = job_embeddings.filter("section <> 'full_description'").select("job_id").distinct()
    lacking = others.join(full.select("job_id"), "job_id", "left_anti")
    return full.unionByName(lacking.withColumn("embedding", F.lit(None).cast("array<float>")))


def score_postings(raw: DataFrame, clean: DataFrame, job_embeddings: DataFrame,
                   profile_embeddings: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON,
                   weights: Mapping[str, float] | None = None, top_n: int = 5) -> DataFrame:
    """One row per processed posting and profile version, without rank.

    ``weights`` may name the overall similarity (alone by default), the share of required or of
    bonus items that mention a profile skill, the similarity of the responsibilities to the
    profile, and the skill match ratio (``COMPONENTS``).

    The matching itself is narrow; what follows are equi joins on ``job_id``."""
    matched = match_profile(full_vectors(job_embeddings), profile_embeddings, top_n)
    skills = technical_skills_text(profile_embeddings).select(
        "profile_version", tags.profile_skills("text", lexicon.profile_skills).alias("_profile_skills"))
    # Components are taken, and their columns read, only where the weights name them.
    items = {score: column for score, column in (("required_match", "qualifications_required"), ("bonus_match", "qualifications_bonus"))
             if score in (weights or ())}
    job_skills = clean.select("job_id", F.coalesce(
        "extracted_skills", F.array().cast("array<string>")).alias("_job_skills"),
        *[F.transform(c, lambda q: q["text"]).alias(f"_{c}") for c in items.values()])
    meta = raw.select("job_id", "company", "job_title", "location", "job_url", "date_posted")
    # The inner join with the clean table is both the lookup of the skills and the filter
    # for processed postings.
    df = matched.join(job_skills, "job_id").join(meta, "job_id").join(
        small_side(skills), "profile_version", "left")
    if "responsibility_alignment" in (weights or ()):
        activities = job_embeddings.filter("section = 'responsibilities'").select("job_id", "embedding")
        aligned = match_profile(activities, profile_embeddings, 1).select(
            "job_id", "profile_version", F.col("overall_similarity").alias("_aligned"))
        df = df.join(aligned, ["job_id", "profile_version"], "left").withColumn(
            "responsibility_alignment", F.coalesce("_aligned", F.lit(0.0)))
    known = F.coalesce("_profile_skills", F.array().cast("array<string>"))
    df = df.withColumns({score: tags.mention_ratio(f"_{column}", known) for score, column in items.items()})
    df = df.withColumn("matched_skills", tags.matched_skills("_job_skills", known))
    df = df.withColumn("missing_skills", tags.missing_skills("_job_skills", known))
    df = df.withColumn("skill_match_ratio", tags.match_ratio("matched_skills", "_job_skills"))
    return df.select(
        "job_id", "profile_version", "overall_similarity", "skill_match_ratio", "matched_skills",
        "missing_skills", F.size("matched_skills").alias("skill_match_count"),
        F.size("missing_skills").alias("skill_gap_count"), composite(weights).alias("composite_score"),
        F.col("matches").alias("best_resume_matches"), "company", "job_title", "location", "job_url",
        "date_posted")


def with_unscored(raw: DataFrame, scored: DataFrame) -> DataFrame:
    """All postings, left outer: the scored ones once per profile version, and those that are not processed
    or have no vector once, with null scores and no version."""
    meta = ["company", "job_title", "location", "job_url", "date_posted"]
    return raw.select("job_id", *meta).join(scored.drop(*meta), "job_id", "left").select(*scored.columns)


def rank_postings(scored: DataFrame) -> DataFrame:
    """Ranks 1..n per profile version by composite score, ties by id."""
    return global_rank(scored, [F.desc("composite_score"), "job_id"], group=["profile_version"])


def granular_scores(job_embeddings: DataFrame, profile_embeddings: DataFrame,
                    per_section: Mapping[str, int] = SECTION_TOP_N,
                    lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """The best rows of every profile section for every posting, with tags of their text."""
    matched = match_profile(full_vectors(job_embeddings), profile_embeddings, per_section=per_section)
    rows = explode_matches(matched)
    content = profile_embeddings.select("profile_version", "ordinal", F.col("full_text").alias("text"))
    content = content.withColumn("_words", tags.tokens("text"))
    content = content.withColumn("entities", tags.entity_map("_words", lexicon.entities, "text")).select(
        "profile_version", "ordinal", tags.extracted_skills("text", "entities", lexicon).alias("extracted_skills"),
        "entities", tags.action_verbs("_words", lexicon.verbs).alias("action_verbs"),
        tags.domain_tags("text", lexicon.tag_domains).alias("domain_tags"))
    return rows.join(small_side(content, 10_000), ["profile_version", "ordinal"]).select(
        "job_id", "profile_version", F.col("section").alias("section_name"),
        F.col("subsection").alias("subsection_name"), "content_type", F.col("text").alias("content_text"),
        "extracted_skills", "entities", "action_verbs", "domain_tags",
        F.col("similarity").alias("similarity_score"), F.current_timestamp().alias("scored_date"))


def rankings_table(ranked: DataFrame) -> DataFrame:
    return ranked.select(
        "job_id", "profile_version", F.col("composite_score").alias("overall_score"), "matched_skills",
        "missing_skills", "skill_match_count", "skill_gap_count", F.current_timestamp().alias("ranked_date"))
