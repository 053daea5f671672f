"""Posting files: a JSON list of objects, or one object, per file.

Files become rows of variants, variants become the canonical columns. Whatever cannot be
used is kept as a row with a reason instead of being dropped or failing the job.
"""

from __future__ import annotations

import datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlens.functions.text import let, one_value
from fitlens.operators.rows import each_item
from fitlens.sources.splits import read_split

# Accepted field names in order, and the default of each canonical column.
ALIASES = {
    "job_title": (("job_title", "title", "position"), "Unknown Title"),
    "company": (("company", "company_name"), "Unknown Company"),
    "location": (("location", "job_location"), None),
    "job_description": (("job_description", "description", "job_details"), None),
    "job_url": (("job_url", "url", "link"), None),
    "salary_range": (("salary_range", "salary"), None),
    "job_type": (("job_type", "employment_type"), None),
}
DATE_ALIASES = ("date_posted", "posted_date")
CANONICAL = (*ALIASES, "date_posted", "source")


#: Files of up to so many bytes are read whole, each by one task.
WHOLE_BYTES = 32 << 20


def read_posting_text(spark: SparkSession, path: str, up_to: int | None = None) -> DataFrame:
    """``file, value``: the text of every ``*.json`` file directly in a folder, of up to so many bytes."""
    texts = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    if up_to is not None:
        texts = texts.filter(F.col("_metadata.file_size") <= up_to)
    return texts.select(F.col("_metadata.file_name").alias("file"), "value")


def _without_bytes(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, doc, reason`` of the files without a byte, which Spark lists but does not read. They are
    invalid like any other that holds no JSON."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    listed = found.inputFiles()
    if found.select("path").count() == len(listed):
        return spark.createDataFrame([], "file string, pos int, doc variant, reason string")
    names = spark.createDataFrame([(unquote(f.rsplit("/", 1)[1]),) for f in listed], "file string")
    read = found.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"))
    return names.join(read, "file", "left_anti").select(
        "file", F.lit(0).alias("pos"), F.lit(None).cast("variant").alias("doc"), F.lit("invalid_file").alias("reason"))


def parse_files(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """``file, pos, doc, reason`` as ``parse_postings`` gives them. Small files are read whole, larger ones
    in ranges by many tasks, with the same rows."""
    small = parse_postings(read_posting_text(spark, path, whole_bytes)).unionByName(_without_bytes(spark, path))
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("length")
    if sizes.filter(F.col("length") > whole_bytes).isEmpty():
        return small
    return small.unionByName(read_split(spark, path, whole_bytes))


def parse_postings(texts: DataFrame) -> DataFrame:
    """``file, pos, doc, reason``: one row per list element.

    ``reason`` is ``invalid_file`` for a file that is no JSON list or object (one row with
    a null document) and ``not_an_object`` for an element of another type. Every element is
    a variant of its own, so only single postings, not files, meet the variant size limit.
    """
    body = F.trim(F.col("value"), F.lit(" \t\r\n﻿"))
    whole = one_value(body)
    as_list = F.when(whole & body.startswith("["), F.from_json(body, "array<variant>", {"allowSingleQuotes": "false"}))
    as_object = F.when(whole & body.startswith("{"), F.try_parse_json(body))
    docs = F.when(as_object.isNotNull(), F.array(as_object)).otherwise(as_list)
    none = F.array(F.lit(None).cast("variant"))
    parsed = texts.select("file", docs.alias("_docs")).withColumn("_bad", F.col("_docs").isNull())
    rows = each_item(parsed, F.coalesce("_docs", none), ["file", "_bad"], "doc")
    kind = F.schema_of_variant(F.col("doc"))
    return rows.select(
        "file", "pos", "doc",
        F.when(F.col("_bad"), "invalid_file")
        .when(F.col("doc").isNull() | ~kind.startswith("OBJECT"), "not_an_object").alias("reason"))


def truthy_text(value: Column, kind: Column) -> Column:
    """Text of a variant, null where the value counts as absent: null, empty text, zero,
    false, an empty list or object. Blank text stays."""
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(kind.isNull() | (kind == "VOID"), None)
        .when(kind == "STRING", F.nullif(text, F.lit("")))
        .when(kind == "BOOLEAN", F.when(text == "true", text))
        .when(kind.isin("ARRAY<VOID>", "OBJECT<>"), F.when(~text.isin("[]", "{}"), text))
        .when(number == 0, None)
        .otherwise(text)
    )


def _field(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "variant")


def first_truthy(doc: Column, names) -> Column:
    """The first alias with a usable value, as text."""
    return F.coalesce(*[
        let(_field(doc, n), lambda v: let(F.schema_of_variant(v), lambda kind: truthy_text(v, kind)))
        for n in names])


ISO_DATE = r"\A\d{4}-\d{2}-\d{2}(?:.\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?\z"


def coerce_date(text: Column, is_number: Column, as_of: Column) -> Column:
    """A date from an epoch in milliseconds or from ISO text, else ``as_of``.

    ISO text gives the date as written, in its own offset: converting to a session time
    first could move it to a neighbouring day."""
    millis = text.try_cast("double").try_cast("bigint")
    in_range = F.abs(millis) < 253402300800000
    from_number = F.to_date(F.timestamp_millis(F.when(in_range, millis)))
    from_text = F.when(text.rlike(ISO_DATE), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    from_text = F.coalesce(from_text, F.when(text.rlike(r"\A\d{8}\z"), F.try_to_date(text, "yyyyMMdd")))
    return F.coalesce(F.when(is_number, from_number).otherwise(from_text), as_of)


def _as_of(as_of: datetime.date | None) -> Column:
    return F.lit(as_of) if as_of else F.current_date()


def normalize_postings(parsed: DataFrame, source: str = "manual",
                       as_of: datetime.date | None = None) -> DataFrame:
    """Canonical columns beside ``file, pos, reason``. A posting without a description gets
    the reason ``missing_description``."""
    doc = F.col("doc")
    columns = []
    for name, (aliases, default) in ALIASES.items():
        value = first_truthy(doc, aliases)
        columns.append((F.coalesce(value, F.lit(default)) if default else value).alias(name))
    dated = F.coalesce(*[
        let(_field(doc, n), lambda v: let(F.schema_of_variant(v), lambda kind: let(
            truthy_text(v, kind), lambda text: F.when(text.isNotNull(), F.struct(text.alias("text"), kind.alias("kind"))))))
        for n in DATE_ALIASES])
    parsed = parsed.withColumn("_dated", dated)
    chosen = F.coalesce("_dated.kind", F.lit(""))
    flag = chosen == "BOOLEAN"
    numeric = flag | chosen.isin("BIGINT", "DOUBLE", "FLOAT") | chosen.startswith("DECIMAL")
    date_text = F.when(flag, "1").otherwise(F.col("_dated.text"))
    # A date that is a list or object, or a number beyond any clock, fails the posting;
    # every other unreadable date becomes ``as_of``.
    beyond = numeric & (F.abs(date_text.try_cast("double")) / 1000 >= float(2 ** 63))
    bad_date = F.coalesce((chosen.startswith("ARRAY") | chosen.startswith("OBJECT") | beyond)
                          & date_text.isNotNull(), F.lit(False))
    out = parsed.select("file", "pos", "reason", *columns, date_text.alias("_date"),
                        F.coalesce(numeric, F.lit(False)).alias("_num"), bad_date.alias("_bad_date"))
    return out.select(
        "file", "pos",
        F.coalesce("reason", F.when(F.col("_bad_date"), "bad_date"),
                   F.when(F.col("job_description").isNull(), "missing_description")).alias("reason"),
        *ALIASES, coerce_date(F.col("_date"), F.col("_num"), _as_of(as_of)).alias("date_posted"),
        F.lit(source).alias("source"))


def read_postings(spark: SparkSession, path: str, source: str = "manual",
                  as_of: datetime.date | None = None) -> DataFrame:
    """All postings of a folder, good and rejected, told apart by ``reason``."""
    return normalize_postings(parse_files(spark, path), source, as_of)
