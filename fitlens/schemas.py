"""Schemas of the stage tables, as DDL strings."""

RAW_POSTINGS = (
    "job_id string, job_title string, company string, location string, job_description string, "
    "job_url string, date_posted date, salary_range string, job_type string, "
    "date_ingested timestamp, source string"
)

INCOMING = (
    "file string, pos int, reason string, job_title string, company string, location string, "
    "job_description string, job_url string, salary_range string, job_type string, "
    "date_posted date, source string"
)

REJECTS = "file string, pos int, reason string"

INTAKE_COUNTS = (
    "stream string, batch bigint, file string, is_total int, inserted bigint, duplicates bigint, errors bigint"
)

QUALIFICATION = "struct<text:string,skill_type:string>"
RESPONSIBILITY = (
    "struct<activity:string,ownership_level:string,frequency:string,activity_type:string>"
)

CLEAN_POSTINGS = (
    "job_id string, job_title_clean string, company string, location string, "
    f"description_clean string, qualifications_required array<{QUALIFICATION}>, "
    f"qualifications_bonus array<{QUALIFICATION}>, responsibilities array<{RESPONSIBILITY}>, "
    "summary string, extracted_skills array<string>, entities map<string,array<string>>, "
    "action_verbs array<string>, domain_tags array<string>, job_url string, date_posted date, "
    "qualifications_required_confidence array<double>, qualifications_bonus_confidence array<double>, "
    "responsibilities_confidence array<double>"
)

JOB_EMBEDDINGS = (
    "job_id string, section string, subsection string, text string, text_hash bigint, "
    "encoder string, embedding array<float>"
)

PROFILE_EMBEDDINGS = (
    "profile_version string, ordinal int, section string, subsection string, "
    "content_type string, text string, full_text string, encoder string, embedding array<float>"
)

RANKINGS = (
    "job_id string, overall_score double, matched_skills array<string>, "
    "missing_skills array<string>, skill_match_count int, skill_gap_count int, "
    "ranked_date timestamp, profile_version string"
)

GRANULAR_SCORES = (
    "job_id string, section_name string, subsection_name string, content_type string, "
    "content_text string, extracted_skills array<string>, entities map<string,array<string>>, "
    "action_verbs array<string>, domain_tags array<string>, similarity_score double, "
    "scored_date timestamp, profile_version string"
)

TABLES = {
    "incoming": INCOMING,
    "rejects": REJECTS,
    "intake_counts": INTAKE_COUNTS,
    "raw_postings": RAW_POSTINGS,
    "clean_postings": CLEAN_POSTINGS,
    "job_embeddings": JOB_EMBEDDINGS,
    "profile_embeddings": PROFILE_EMBEDDINGS,
    "rankings": RANKINGS,
    "granular_scores": GRANULAR_SCORES,
}
