"""Loading, and the posting-shaped text that both sides of a check are built from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlens.sources.tables import spread


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_wide(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """For work that costs much more per row than reading the row."""
    return spread(load(spark, sf_dir, name).select(*columns))


# The driver's prose has no section headings and few list words, so a few of its words
# become words of the lists, and the lines become bullets of three styles. Valid in Spark
# and in the checking engine alike.
BODY = (
    "replace(replace(replace(replace(replace(replace(text, ' that ', ' weekly '), ' for ', ' assist '), "
    "' are ', ' dashboard '), ' with ', ' communication '), ' this ', ' sql '), "
    "' from ', ' 5 years experience with ')"
)
_Q = f"'- ' || replace({BODY}, chr(10), chr(10) || '- ')"
_R = f"'* ' || replace({BODY}, '. ', '.' || chr(10) || '* ')"
_N = f"'1. ' || replace({BODY}, '. ', chr(10) || '2) ')"
POSTING = (
    "CASE doc_id % 4 "
    f"WHEN 0 THEN 'About ' || source || chr(10) || 'Requirements' || chr(10) || {_Q} || chr(10) || "
    f"'Your role:' || chr(10) || {_R} "
    f"WHEN 1 THEN 'Responsibilities:' || chr(10) || {_R} || chr(10) || chr(10) || 'You have (preferred):' "
    f"|| chr(10) || 'a) one of' || chr(10) || {_Q} "
    f"WHEN 2 THEN 'Who we are in ' || lang || chr(10) || 'In this role' || chr(10) || 'Duties' || chr(10) || {_N} "
    f"ELSE {BODY} END"
)
CHECK_POSTINGS = f"p AS (SELECT doc_id, {POSTING} AS body FROM documents)"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, body``: every document as a posting."""
    docs = load_wide(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    return with_body(docs).select("doc_id", F.expr(over_body(POSTING)).alias("body"))


def with_body(docs: DataFrame) -> DataFrame:
    """``docs`` and ``_body``, the text with words of the lists: put in once, though postings may hold it twice."""
    return docs.withColumn("_body", F.expr(BODY))


def over_body(sql: str) -> str:
    """The same SQL over ``with_body``."""
    return sql.replace(BODY, "_body")


def any_of(column: str, words) -> str:
    """SQL test for at least one substring."""
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def first_of(column: str, table, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(column, w)} THEN '{n}'" for n, w in table.items()) + f" ELSE '{default}' END"


def text_values(words) -> str:
    """SQL rows of one text column."""
    return ", ".join("('" + w.replace("'", "''") + "')" for w in words)


def check_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def check_whitespace(x: str) -> str:
    collapsed = rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g')"
    lines = f"list_transform(string_split({collapsed}, chr(10)), lambda s: {check_strip('s')})"
    return check_strip(f"array_to_string({lines}, chr(10))")


def check_html(x: str) -> str:
    x = rf"regexp_replace(replace({x}, '&<', '&amp;<'), '(&(?:lt|gt|quot|copy|middot|nbsp|amp))<', '\1;<', 'g')"
    for pattern in (r"<script\b[^>]*>.*?</script\s*>", r"<style\b[^>]*>.*?</style\s*>", r"<!--.*?-->",
                    r"<![a-zA-Z][^>]*>", r"</?[a-zA-Z][^>]*>"):
        x = f"regexp_replace({x}, '{pattern}', '', 'gis')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", "\u00a0"),
                       ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


BULLET = r"^(?:[•\-*]|\d+[.)]|[a-z][.)])\s+(.+)$"
WIDE_BULLET = r"^(?:[•\-*◦○▪▫]|\d+[.)]|[a-zA-Z][.)])\s+(.+)$"


def check_bullets(source: str, name: str, pattern: str = BULLET) -> str:
    """CTEs ending in ``name(doc_id, o, txt)``: the bullets of ``source(doc_id, txt)``."""
    return rf"""
{name}_l AS (SELECT doc_id, unnest(string_split(txt, chr(10))) AS line,
                    generate_subscripts(string_split(txt, chr(10)), 1) AS i FROM {source}),
{name}_x AS (SELECT doc_id, i, {check_strip('line')} AS x FROM {name}_l),
{name}_b AS (SELECT doc_id, i, x, regexp_matches(x, '{pattern}') AS isb FROM {name}_x WHERE x <> ''),
{name}_o AS (SELECT *, sum(isb::INT) OVER (PARTITION BY doc_id ORDER BY i) AS o FROM {name}_b),
{name} AS (SELECT doc_id, o::INT AS o,
                  string_agg(CASE WHEN isb THEN regexp_extract(x, '{pattern}', 1) ELSE x END, ' ' ORDER BY i) AS txt
           FROM {name}_o WHERE o >= 1 GROUP BY doc_id, o)"""


def check_sections(q_test: str, r_test: str, prefix: str = "s") -> str:
    """CTEs ending in ``{prefix}(doc_id, qual_text, resp_text, summary)`` over ``p(doc_id, body)``.
    The tests read the lower-cased line ``lo``."""
    p = prefix
    return rf"""
{p}_l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line,
                 generate_subscripts(string_split(body, chr(10)), 1) AS i FROM p),
{p}_t AS (SELECT *, CASE WHEN {q_test} THEN 'q' WHEN {r_test} THEN 'r' END AS tag
          FROM (SELECT *, lower(line) AS lo FROM {p}_l)),
{p}_i AS (SELECT doc_id, count(*) AS n, min(i) FILTER (tag = 'q') AS qi, min(i) FILTER (tag = 'r') AS ri
          FROM {p}_t GROUP BY doc_id),
{p}_m AS (SELECT t.doc_id, t.i, t.line, s.qi, s.ri,
                 i >= qi AND i < CASE WHEN ri > qi THEN ri ELSE n + 1 END AS in_q,
                 i >= ri AND i < CASE WHEN qi > ri THEN qi ELSE n + 1 END AS in_r,
                 CASE WHEN qi > ri THEN NULL ELSE coalesce(least(qi, ri), n + 1) END AS cut
          FROM {p}_t t JOIN {p}_i s USING (doc_id)),
{p} AS (SELECT doc_id,
               string_agg(line, chr(10) ORDER BY i) FILTER (in_q) || CASE WHEN any_value(ri) > any_value(qi) THEN chr(10) ELSE '' END AS qual_text,
               string_agg(line, chr(10) ORDER BY i) FILTER (in_r) || CASE WHEN any_value(qi) > any_value(ri) THEN chr(10) ELSE '' END AS resp_text,
               {check_strip(f'''CASE WHEN any_value(qi) > any_value(ri)
                    THEN coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (i < qi), '') || chr(10) || chr(10) || chr(10)
                         || string_agg(line, chr(10) ORDER BY i) FILTER (i >= qi)
                    ELSE coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (i < cut), '') END''')} AS summary
        FROM {p}_m GROUP BY doc_id)"""
