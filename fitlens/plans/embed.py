"""Texts of postings and profiles to vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlens.functions.vectors import DEFAULT_DIM, embed_text, embed_text_with
from fitlens.lexicon import MIN_SUMMARY_CHARS, STORED_TEXT_CHARS
from fitlens.functions.text import strip
from fitlens.operators.rows import each_item
from fitlens.sources.profile import profile_rows

#: Name of the encoder that is used where none is given; stored beside every vector.
DEFAULT_ENCODER = f"hashed/{DEFAULT_DIM}"


def posting_sections(clean: DataFrame) -> DataFrame:
    """``job_id, section, text``: up to four texts per posting, from one pass over the row.

    Required items come before bonus items; a summary counts from 51 characters on."""
    quals = F.array_join(F.transform(F.concat("qualifications_required", "qualifications_bonus"),
                                     lambda q: q["text"]), " ")
    resps = F.array_join(F.transform("responsibilities", lambda r: r["activity"]), " ")
    long_summary = F.when(F.length(strip("summary")) > MIN_SUMMARY_CHARS, F.col("summary"))
    texts = F.array(*[
        F.struct(F.lit(name).alias("section"), text.alias("text")) for name, text in (
            ("full_description", F.col("description_clean")), ("qualifications", quals),
            ("responsibilities", resps), ("summary", long_summary))])
    kept = F.filter(texts, lambda t: t["text"].isNotNull() & (t["text"] != ""))
    return each_item(clean, kept, ["job_id"], "_t").select("job_id", "_t.section", "_t.text")


def _keyed(sections: DataFrame, encoder: str) -> DataFrame:
    return sections.withColumns({"text_hash": F.xxhash64("text"), "encoder": F.lit(encoder)})


VECTOR_KEY = ["job_id", "section", "text_hash", "encoder"]


def new_sections(sections: DataFrame, embedded: DataFrame, encoder: str = DEFAULT_ENCODER) -> DataFrame:
    """Sections without a vector of this encoder for their present text, so that a repeated run
    embeds only what is new."""
    return _keyed(sections, encoder).join(embedded.select(*VECTOR_KEY), VECTOR_KEY, "left_anti")


def stale_vectors(sections: DataFrame, embedded: DataFrame, encoder: str = DEFAULT_ENCODER) -> DataFrame:
    """Vectors of other encoders, or of texts that no posting has any more."""
    return embedded.join(_keyed(sections, encoder).select(*VECTOR_KEY), VECTOR_KEY, "left_anti")


def _vector(text: str, embed, dim: int, load):
    return embed_text_with(text, load) if load else embed_text(text, embed, dim)


def embed_sections(sections: DataFrame, embed=None, dim: int = DEFAULT_DIM, load=None,
                   encoder: str = DEFAULT_ENCODER) -> DataFrame:
    """Vectors of posting sections, with the text cut for storage after embedding. ``load`` runs
    once per task and returns the function that embeds."""
    text_hash = F.col("text_hash") if "text_hash" in sections.columns else F.xxhash64("text")
    return sections.select(
        "job_id", "section", F.lit(None).cast("string").alias("subsection"),
        F.substring("text", 1, STORED_TEXT_CHARS).alias("text"), text_hash.alias("text_hash"),
        F.lit(encoder).alias("encoder"), _vector("text", embed, dim, load).alias("embedding"))


def embed_profiles(profiles: DataFrame, embed=None, dim: int = DEFAULT_DIM, load=None,
                   encoder: str = DEFAULT_ENCODER) -> DataFrame:
    """Vectors of all rows of the profiles, the text cut for display and whole."""
    return profile_rows(profiles).select(
        "profile_version", "ordinal", "section", "subsection", "content_type",
        F.substring("text", 1, STORED_TEXT_CHARS).alias("text"), F.col("text").alias("full_text"),
        F.lit(encoder).alias("encoder"), _vector("text", embed, dim, load).alias("embedding"))


def embed_again(embedded: DataFrame, embed=None, dim: int = DEFAULT_DIM, load=None,
                encoder: str = DEFAULT_ENCODER) -> DataFrame:
    """Stored profile rows with vectors of another encoder, from their whole texts."""
    return embedded.withColumns({"encoder": F.lit(encoder), "embedding": _vector("full_text", embed, dim, load)})
