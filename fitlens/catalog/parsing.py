"""Cleaning, sections, bullets and classes over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitlens import lexicon as lx
from fitlens.catalog.shared import (
    BODY, CHECK_POSTINGS, WIDE_BULLET, any_of, check_bullets, check_html, check_sections, check_strip,
    check_whitespace, first_of, load_wide, postings)
from fitlens.functions import sections as sec
from fitlens.functions.text import clean_html, clean_text, normalize_whitespace, truncate
from fitlens.operators.evaluate import compare_parsers, parse_quality
from fitlens.operators.rows import each_item
from fitlens.plans.embed import posting_sections

Q_TEST = any_of("lo", lx.QUALIFICATION_HEADERS)
R_TEST = any_of("lo", lx.RESPONSIBILITY_HEADERS)
Q_REGEX = " OR ".join(f"regexp_matches(lo, '{p.replace(chr(39), chr(39) * 2)}')" for p in lx.QUALIFICATION_PATTERNS)
R_REGEX = " OR ".join(f"regexp_matches(lo, '{p.replace(chr(39), chr(39) * 2)}')" for p in lx.RESPONSIBILITY_PATTERNS)
SECTIONS = f"WITH {CHECK_POSTINGS}, {check_sections(Q_TEST, R_TEST)}"
QUAL_ITEMS = f"""
qt AS (SELECT doc_id, qual_text AS txt FROM s WHERE qual_text IS NOT NULL), {check_bullets('qt', 'qb')},
qi AS (SELECT doc_id, o, qb.txt AS item, CASE WHEN {any_of('lower(qb.txt)', lx.SOFT_SKILLS)} THEN 'Soft' ELSE 'Hard' END AS skill_type,
              CASE WHEN {any_of("lower(qb.txt || ' ' || substr(qt.txt, 1, 200))", lx.BONUS_WORDS)} THEN 'bonus' ELSE 'required' END AS kind
       FROM qb JOIN qt USING (doc_id))"""
RESP_ITEMS = f"""
rt AS (SELECT doc_id, resp_text AS txt FROM s WHERE resp_text IS NOT NULL), {check_bullets('rt', 'rb')}"""
MESSY = ("replace(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10) || chr(9) || '  '), ', ', ',    ')")


def html_clean(spark, sf):
    pages = load_wide(spark, sf, "pages", "page_id", "html")
    return pages.select("page_id", clean_html("html").alias("plain"), clean_text("html").alias("cleaned"))


def whitespace_normalize(spark, sf):
    docs = load_wide(spark, sf, "documents", "doc_id", "text").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), "text")
    talks = load_wide(spark, sf, "conversations", "conv_id", "turn", "text").select(
        F.lit("conversations").alias("origin"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("part"), "text")
    return docs.unionByName(talks).select("origin", "id", "part", normalize_whitespace(F.expr(MESSY)).alias("cleaned"))


def section_split(spark, sf):
    return sec.with_sections(postings(spark, sf), "body").drop("body")


def section_split_regex(spark, sf):
    return sec.with_sections(postings(spark, sf), "body", mode="regex").drop("body")


def bullet_extract(spark, sf):
    return each_item(postings(spark, sf), sec.bullets("body"), ["doc_id"], "bullet")


def wide_bullets(spark, sf):
    docs = load_wide(spark, sf, "documents", "doc_id", "text")
    marked = F.expr("'▪ ' || replace(replace(text, chr(10), chr(10) || 'B) '), '. ', '.' || chr(10) || '◦ ')")
    return each_item(docs, sec.bullets(marked, sec.WIDE_MARKERS), ["doc_id"], "bullet")


def qualification_parse(spark, sf):
    df = sec.with_sections(postings(spark, sf), "body")
    return each_item(df, sec.classified_qualifications("qual_text"), ["doc_id"], "_q").select(
        "doc_id", "pos", "_q.text", "_q.skill_type", "_q.kind")


def responsibility_parse(spark, sf):
    df = sec.with_sections(postings(spark, sf), "body")
    return each_item(df, sec.responsibilities("resp_text"), ["doc_id"], "_r").select("doc_id", "pos", "_r.*")


def section_union(spark, sf):
    df = sec.parse_description(postings(spark, sf), "body")
    texts = posting_sections(df.select(
        F.col("doc_id").alias("job_id"), F.col("body").alias("description_clean"), "qualifications_required",
        "qualifications_bonus", "responsibilities", "summary"))
    return texts.select("job_id", "section", truncate("text", lx.STORED_TEXT_CHARS).alias("stored_text"),
                        F.length("text").alias("n_chars"))


def variant_compare(spark, sf):
    return compare_parsers(postings(spark, sf), "body", "doc_id", sec.BASIC, sec.Parser(mode="regex"))


def low_confidence_items(spark, sf):
    parsed = sec.parse_description(postings(spark, sf), "body", confidence=True)
    return sec.low_confidence_items(parsed, "doc_id")


def quality_metrics(spark, sf):
    stats = parse_quality(sec.parse_description(postings(spark, sf), "body"))
    return stats.select("n_postings", *[F.round(c, 6).alias(c) for c in stats.columns if c != "n_postings"])


SUBSECTIONS = (f"'Qualifications' || chr(10) || 'Required:' || chr(10) || '- ' || replace({BODY}, '. ', '.' || chr(10) || '- ') || "
               f"chr(10) || 'Preferred skills:' || chr(10) || '* ' || replace({BODY}, chr(10), chr(10) || '* ')")


def subsection_class(spark, sf):
    docs = load_wide(spark, sf, "documents", "doc_id", "text")
    return each_item(docs, sec.subsection_classes(F.expr(SUBSECTIONS)), ["doc_id"], "_i").select(
        "doc_id", "pos", "_i.text", "_i.kind")


def bullet_confidence(spark, sf):
    items = each_item(postings(spark, sf), sec.bullets("body"), ["doc_id"], "_b")
    return items.select("doc_id", "pos", sec.confidence("_b").alias("as_qualification"),
                        sec.confidence("_b", sec.RESPONSIBILITY_SIGNALS).alias("as_responsibility"))


PITCH = (f"{BODY} || ' Salary range on request. We are committed to ' || source || ' diversity.' || chr(10) || "
         f"'Benefits: ' || lang || ' dental. Join us.'")


def boilerplate_drop(spark, sf):
    docs = load_wide(spark, sf, "documents", "doc_id", "text", "source", "lang")
    return docs.select("doc_id", sec.drop_boilerplate(F.expr(PITCH)).alias("summary"))


def _signal_sum(signals):
    total = "0.3"
    for pattern, weight in signals:
        quoted = pattern.replace("'", "''")
        total += f" + CASE WHEN regexp_matches(lower(txt), '{quoted}') THEN {weight} ELSE 0 END"
    return f"round(greatest(0.0, least(1.0, ({total})::DOUBLE)), 6)"


def _boilerplate_sql(x):
    for pattern in lx.BOILERPLATE_PATTERNS:
        x = f"regexp_replace({x}, '{pattern}', '', 'gi')"
    return check_strip(x)


def _parsed_counts(prefix, q_test, r_test):
    p = prefix
    return f"""{check_sections(q_test, r_test, p)},
{p}_qt AS (SELECT doc_id, qual_text AS txt FROM {p} WHERE qual_text IS NOT NULL), {check_bullets(p + '_qt', p + '_qb')},
{p}_rt AS (SELECT doc_id, resp_text AS txt FROM {p} WHERE resp_text IS NOT NULL), {check_bullets(p + '_rt', p + '_rb')},
{p}_qk AS (SELECT b.doc_id, {any_of("lower(b.txt || ' ' || substr(t.txt, 1, 200))", lx.BONUS_WORDS)} AS bonus
           FROM {p}_qb b JOIN {p}_qt t USING (doc_id)),
{p}_qc AS (SELECT doc_id, count(*) FILTER (NOT bonus) AS required, count(*) FILTER (bonus) AS bonus FROM {p}_qk GROUP BY 1),
{p}_rc AS (SELECT doc_id, count(*) AS duties FROM {p}_rb GROUP BY 1),
{p}_c AS (SELECT doc_id, coalesce(required, 0)::INT AS required, coalesce(bonus, 0)::INT AS bonus,
                 coalesce(duties, 0)::INT AS duties, length(summary)::INT AS summary_chars
          FROM {p} LEFT JOIN {p}_qc USING (doc_id) LEFT JOIN {p}_rc USING (doc_id))"""


QUERIES = {
    "html_clean": (html_clean, f"SELECT page_id, {check_html('html')} AS plain, {check_whitespace(check_html('html'))} AS cleaned FROM pages"),
    "whitespace_normalize": (whitespace_normalize, f"""
        SELECT 'documents' AS origin, doc_id AS id, 0::BIGINT AS part, {check_whitespace(MESSY)} AS cleaned FROM documents
        UNION ALL SELECT 'conversations', conv_id, turn::BIGINT, {check_whitespace(MESSY)} FROM conversations"""),
    "section_split": (section_split, f"{SECTIONS} SELECT doc_id, qual_text, resp_text, summary FROM s"),
    "section_split_regex": (section_split_regex, f"WITH {CHECK_POSTINGS}, {check_sections(Q_REGEX, R_REGEX)} SELECT doc_id, qual_text, resp_text, summary FROM s"),
    "bullet_extract": (bullet_extract, f"WITH {CHECK_POSTINGS}, pt AS (SELECT doc_id, body AS txt FROM p), {check_bullets('pt', 'b')} "
                       "SELECT doc_id, o - 1 AS pos, txt AS bullet FROM b"),
    "wide_bullets": (wide_bullets, f"""WITH pt AS (SELECT doc_id, '▪ ' || replace(replace(text, chr(10), chr(10) || 'B) '), '. ', '.' || chr(10) || '◦ ') AS txt
        FROM documents), {check_bullets('pt', 'b', WIDE_BULLET)} SELECT doc_id, o - 1 AS pos, txt AS bullet FROM b"""),
    "qualification_parse": (qualification_parse, f"{SECTIONS}, {QUAL_ITEMS} SELECT doc_id, o - 1 AS pos, item AS text, skill_type, kind FROM qi"),
    "responsibility_parse": (responsibility_parse, f"""{SECTIONS}, {RESP_ITEMS}
        SELECT doc_id, o - 1 AS pos, txt AS activity, {first_of('lower(txt)', lx.OWNERSHIP, 'lead')} AS ownership_level,
               {first_of('lower(txt)', lx.FREQUENCY, 'regularly')} AS frequency,
               {first_of('lower(txt)', lx.ACTIVITY_DOMAINS, 'General')} AS activity_type FROM rb"""),
    "section_union": (section_union, f"""{SECTIONS}, {QUAL_ITEMS}, {RESP_ITEMS},
        u AS (SELECT doc_id, 'full_description' AS section, body AS t FROM p
              UNION ALL SELECT doc_id, 'qualifications', string_agg(item, ' ' ORDER BY kind DESC, o) FROM qi GROUP BY 1
              UNION ALL SELECT doc_id, 'responsibilities', string_agg(txt, ' ' ORDER BY o) FROM rb GROUP BY 1
              UNION ALL SELECT doc_id, 'summary', summary FROM s WHERE length(summary) > 50)
        SELECT doc_id AS job_id, section, substr(t, 1, 500) AS stored_text, length(t)::INT AS n_chars FROM u WHERE t <> ''"""),
    "variant_compare": (variant_compare, f"""WITH {CHECK_POSTINGS}, {_parsed_counts('a', Q_TEST, R_TEST)}, {_parsed_counts('b', Q_REGEX, R_REGEX)}
        SELECT a.doc_id, a.required AS required_a, b.required AS required_b, b.required - a.required AS required_delta,
               a.bonus AS bonus_a, b.bonus AS bonus_b, b.bonus - a.bonus AS bonus_delta,
               a.duties AS duties_a, b.duties AS duties_b, b.duties - a.duties AS duties_delta,
               a.summary_chars AS summary_chars_a, b.summary_chars AS summary_chars_b,
               b.summary_chars - a.summary_chars AS summary_chars_delta FROM a_c a JOIN b_c b USING (doc_id)"""),
    "quality_metrics": (quality_metrics, f"""WITH {CHECK_POSTINGS}, {_parsed_counts('a', Q_TEST, R_TEST)}
        SELECT count(*) AS n_postings, round(avg(CASE WHEN required + bonus + duties > 0 THEN 1.0 ELSE 0.0 END), 6) AS detection_rate,
               round(avg(required + bonus), 6) AS avg_qualifications, round(avg(duties), 6) AS avg_responsibilities FROM a_c"""),
    "subsection_class": (subsection_class, f"""WITH pr AS (SELECT doc_id, '- ' || replace({BODY}, '. ', '.' || chr(10) || '- ') AS txt FROM documents),
        pb AS (SELECT doc_id, '* ' || replace({BODY}, chr(10), chr(10) || '* ') AS txt FROM documents),
        {check_bullets('pr', 'r', WIDE_BULLET)}, {check_bullets('pb', 'b', WIDE_BULLET)},
        n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY 1)
        SELECT doc_id, o - 1 AS pos, txt AS text, 'required' AS kind FROM r
        UNION ALL SELECT b.doc_id, (b.o - 1 + coalesce(n.n, 0))::INT, b.txt, 'bonus' FROM b LEFT JOIN n USING (doc_id)"""),
    "bullet_confidence": (bullet_confidence, f"""WITH {CHECK_POSTINGS}, pt AS (SELECT doc_id, body AS txt FROM p), {check_bullets('pt', 'b')}
        SELECT doc_id, o - 1 AS pos, {_signal_sum(sec.QUALIFICATION_SIGNALS)} AS as_qualification,
               {_signal_sum(sec.RESPONSIBILITY_SIGNALS)} AS as_responsibility FROM b"""),
    "low_confidence_items": (low_confidence_items, f"""{SECTIONS}, {QUAL_ITEMS}, {RESP_ITEMS},
        q AS (SELECT doc_id, kind, (row_number() OVER (PARTITION BY doc_id, kind ORDER BY o) - 1)::INT AS pos, item AS txt FROM qi),
        c AS (SELECT *, {_signal_sum(sec.QUALIFICATION_SIGNALS)} AS confidence FROM q
              UNION ALL SELECT doc_id, 'responsibility', o - 1, txt, {_signal_sum(sec.RESPONSIBILITY_SIGNALS)} FROM rb)
        SELECT doc_id, kind, pos, txt AS text, confidence FROM c WHERE confidence < {sec.LOW_CONFIDENCE}"""),
    "boilerplate_drop": (boilerplate_drop, f"SELECT doc_id, {_boilerplate_sql(PITCH)} AS summary FROM documents"),
}
