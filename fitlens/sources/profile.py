"""Profile documents: a JSON object of sections, each a list of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlens.operators.match import OVERALL
from fitlens.operators.rows import each_item

_ITEMS = "array<struct<Content:string,Subsection:string,Bullet:string>>"
_ROWS = "array<struct<section:string,subsection:string,content_type:string,text:string>>"


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """``profile_version, sections`` per profile file; the version is the file's stem.

    ``sections`` is an array in document order. Sections that are no list are skipped, and
    so is a ``Bullet`` that is no list. A missing path raises."""
    text = spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.json\z", "").alias("profile_version"), "value")
    return text.select("profile_version", parse_sections(F.col("value")).alias("sections"))


def parse_sections(value: Column) -> Column:
    """Sections of one profile text: ``array<struct<section, items>>`` in document order."""
    entries = F.map_entries(F.from_json(value, "map<string,string>"))
    lists = F.filter(entries, lambda e: e["value"].rlike(r"\A\s*\["))
    return F.transform(lists, lambda e: F.struct(
        e["key"].alias("section"),
        F.transform(F.from_json(e["value"], _ITEMS), lambda i: F.struct(
            i["Content"].alias("Content"), i["Subsection"].alias("Subsection"),
            F.coalesce(F.when(i["Bullet"].rlike(r"\A\s*\["), F.from_json(i["Bullet"], "array<string>")),
                       F.array().cast("array<string>")).alias("Bullet"))).alias("items")))


def _row(section: Column, subsection: Column, kind: str, text: Column) -> Column:
    return F.struct(section.alias("section"), subsection.alias("subsection"),
                    F.lit(kind).alias("content_type"), text.alias("text"))


def overall_text(sections: Column | str) -> Column:
    """All texts of a profile in document order: per item content, subsection, bullets."""
    sections = F.col(sections) if isinstance(sections, str) else sections
    parts = F.flatten(F.transform(sections, lambda s: F.flatten(F.transform(s["items"], lambda i: F.concat(
        F.array_compact(F.array(i["Content"], i["Subsection"])), i["Bullet"])))))
    return F.array_join(parts, " ")


def profile_rows(profiles: DataFrame, stored_chars: int | None = None) -> DataFrame:
    """``profile_version, ordinal, section, subsection, content_type, text``: the whole
    profile first, then contents, subsections with their bullets, and single bullets.

    The rows are built inside the document's row and exploded with their position, so
    document order needs no sort. ``stored_chars`` cuts the text."""
    none = F.lit(None).cast("string")

    def of_item(section: Column, item: Column) -> Column:
        content, sub, bullets = item["Content"], item["Subsection"], item["Bullet"]
        alone = F.when(content.isNotNull() & sub.isNull(), F.array(_row(section, none, "content", content)))
        joined = F.array_join(F.concat(F.array(sub), bullets), " ")
        nested = F.when(sub.isNotNull(), F.concat(
            F.array(_row(section, sub, "subsection", joined)),
            F.transform(bullets, lambda b: _row(section, sub, "bullet", b))))
        return F.coalesce(alone, nested, F.array().cast(_ROWS))

    items = F.flatten(F.transform("sections", lambda s: F.flatten(
        F.transform(s["items"], lambda i: of_item(s["section"], i)))))
    whole = F.array(_row(F.lit(OVERALL), none, "full_resume", overall_text("sections")))
    rows = each_item(profiles, F.concat(whole, items), ["profile_version"], "_r", "ordinal")
    text = F.col("_r.text") if stored_chars is None else F.substring("_r.text", 1, stored_chars)
    return rows.select("profile_version", "ordinal", "_r.section", "_r.subsection", "_r.content_type",
                       text.alias("text"))


def technical_skills_text(embedded: DataFrame, section: str = "TechnicalSkills") -> DataFrame:
    """``profile_version, text``: the whole first row of the skills section of each version."""
    return (
        embedded.filter(F.col("section") == section).groupBy("profile_version")
        .agg(F.min_by("full_text", "ordinal").alias("text"))
    )
