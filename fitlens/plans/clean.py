"""Raw postings to clean, parsed and tagged postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlens.functions import tags
from fitlens.functions.sections import BASIC, Parser, parse_description
from fitlens.functions.text import clean_text
from fitlens.lexicon import DEFAULT_LEXICON, Lexicon
from fitlens.operators.gazetteer import tag_entities
from fitlens.operators.tagging import tag_verbs, tag_with


def clean_postings(raw: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, parser: Parser = BASIC,
                   load_tagger=None, gazetteer: DataFrame | None = None, verbs: DataFrame | None = None) -> DataFrame:
    """The whole per-posting transformation. Narrow, unless entities come from a gazetteer table
    (``name, label``) or verbs from a verb table (``form, lemma``), which are joined.

    ``load_tagger`` runs once per task and returns a tagger for entities and verbs; without it
    they come from the lexicon. Spelling is kept until tagging, which works on the cleaned
    description."""
    df = raw.select("job_id", "job_title", "company", "location", "job_url", "date_posted",
                    clean_text("job_description").alias("description_clean"))
    if load_tagger:
        df = tag_with(df, "description_clean", load_tagger)
    texts = df.select("job_id", "description_clean")
    df = parse_description(df, "description_clean", lexicon, parser)
    if not load_tagger:
        df = df.withColumn("_words", tags.tokens("description_clean"))
        verbs_of = tags.action_verbs("_words", lexicon.verbs)
        if lexicon.guess_verbs:
            verbs_of = F.array_sort(F.array_union(verbs_of, tags.unseen_verbs("_words", lexicon.verbs)))
        df = df.withColumns({"entities": tags.entity_map("_words", lexicon.entities, "description_clean"),
                             "action_verbs": verbs_of})
    if gazetteer is not None:
        found = tag_entities(texts, "description_clean", gazetteer)
        none = F.create_map().cast("map<string,array<string>>")
        df = df.drop("entities").join(found, "job_id", "left").withColumn("entities", F.coalesce("entities", none))
    if verbs is not None:
        found = tag_verbs(texts, "description_clean", verbs)
        none = F.array().cast("array<string>")
        df = df.drop("action_verbs").join(found, "job_id", "left").withColumn("action_verbs", F.coalesce("action_verbs", none))
    return df.select(
        "job_id", F.col("job_title").alias("job_title_clean"), "company", "location",
        "description_clean", "qualifications_required", "qualifications_bonus", "responsibilities",
        "summary", tags.extracted_skills("description_clean", "entities", lexicon).alias("extracted_skills"),
        "entities", "action_verbs", tags.domain_tags("description_clean", lexicon.tag_domains).alias("domain_tags"),
        "job_url", "date_posted", "qualifications_required_confidence", "qualifications_bonus_confidence",
        "responsibilities_confidence")
