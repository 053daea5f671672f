"""Keywords, domains, entities, verbs, skill overlap, and the whole cleaning step."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlens import lexicon as lx
from fitlens.catalog.parsing import QUAL_ITEMS, RESP_ITEMS, Q_TEST, R_TEST
from fitlens.catalog.shared import (
    POSTING, any_of, check_html, check_sections, check_whitespace, load, load_wide, over_body, text_values, with_body)
from fitlens.functions import tags
from fitlens.operators.rows import each_item
from fitlens.operators.gazetteer import tag_entities
from fitlens.plans.clean import clean_postings

# A small lexicon of words that the driver's prose has.
NAMES = {"The": "ORG", "Of the": "ORG", "Eriner": "ORG", "This": "PRODUCT", "to the": "PRODUCT", "thing": "PRODUCT",
         "in the": "GPE", "And": "GPE", "biti": "GPE", "reble": "PERSON", "is the": "PERSON"}
FORMS = {"was": "be", "is": "be", "are": "be", "be": "be", "thing": "thing", "ating": "ate", "ining": "in", "had": "have"}
MARKS = ("th", "bi")
LEX = replace(lx.DEFAULT_LEXICON, entities=NAMES, verbs=FORMS, entity_skill_marks=MARKS)
TOKENS = rf"regexp_extract_all(%s, '{tags.TOKEN.replace('++', '+').replace('*+', '*').replace(chr(39), chr(39) * 2)}')"
KEYWORDS = f"kw(k) AS (VALUES {text_values(lx.POSTING_SKILLS)})"
PROFILE_WORDS = ", ".join(f"('{w}', {i})" for i, w in enumerate(lx.PROFILE_SKILLS))
NAME_ROWS = ", ".join(f"('{n}', '{label}')" for n, label in NAMES.items())
FORM_ROWS = ", ".join(f"('{f}', '{v}')" for f, v in FORMS.items())


EXCEPTION_ROWS = ", ".join(f"('{f}', '{v or ''}')" for f, v in lx.VERB_EXCEPTIONS.items())
VERB_CASES = " ".join(f"WHEN regexp_matches(w, '{test}') THEN regexp_replace(w, '{off}', '{put}')" for test, off, put in lx.VERB_RULES)


def _keywords(source, text, key, out):
    return rf"""{out} AS (SELECT DISTINCT {key}, regexp_extract({text}, '(?i)' || regexp_escape(k), 0) AS w
        FROM {source}, kw WHERE contains(lower({text}), k))"""


def _joined(x):
    return F.array_join(x, "|")


def keyword_skills(spark, sf):
    docs = load_wide(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", _joined(tags.keyword_hits("text", lx.POSTING_SKILLS)).alias("skills"))


def keyword_skills_whole_word(spark, sf):
    words = ("in", "the", "thing", "ai", "r", "est", "rest")
    docs = load_wide(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", _joined(tags.keyword_hits("text", words, "word")).alias("skills"))


def profile_skills(spark, sf):
    items = load(spark, sf, "benchmark")
    return items.select("item_id", _joined(tags.profile_skills("text")).alias("skills"))


def domain_tags(spark, sf):
    docs = load_wide(spark, sf, "documents", "doc_id", "text", "source", "lang")
    return docs.select("doc_id", _joined(tags.domain_tags(F.expr(POSTING))).alias("domains"))


def entity_map(spark, sf):
    docs = load_wide(spark, sf, "documents", "doc_id", "text").withColumn("_w", tags.tokens("text"))
    found = each_item(docs, F.map_entries(tags.entity_map("_w", NAMES)), ["doc_id"], "_e")
    return found.select("doc_id", F.col("_e.key").alias("label"), _joined("_e.value").alias("names"))


def entity_gazetteer(spark, sf):
    words = load(spark, sf, "benchmark").select(F.explode(F.array_distinct(tags.tokens("text"))).alias("name")).distinct()
    gazetteer = words.select("name", F.when(F.length("name") % 2 == 0, "even").otherwise("odd").alias("label"))
    docs = load_wide(spark, sf, "documents", "doc_id", "text")
    tagged = tag_entities(docs, "text", gazetteer, "doc_id", max_words=2)
    return tagged.select("doc_id", F.explode("entities").alias("label", "_n")).select("doc_id", "label", _joined("_n").alias("names"))


def entity_gazetteer_long(spark, sf):
    """Names are all runs of one to six words of the benchmark, as they are written there."""
    raw = load(spark, sf, "benchmark").select(F.split("text", " ").alias("w"))

    def runs(n):
        each = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
        return raw.filter(F.size("w") >= n).select(F.explode(each).alias("name"), F.lit(f"words {n}").alias("label"))

    gazetteer = reduce(DataFrame.unionByName, map(runs, range(1, 7)))
    docs = load_wide(spark, sf, "documents", "doc_id", "text")
    tagged = tag_entities(docs, "text", gazetteer, "doc_id")
    return tagged.select("doc_id", F.explode("entities").alias("label", "_n")).select("doc_id", "label", _joined("_n").alias("names"))


def action_verbs(spark, sf):
    docs = load_wide(spark, sf, "documents", "doc_id", "text").withColumn("_w", tags.tokens("text"))
    return docs.select("doc_id", _joined(tags.action_verbs("_w", FORMS)).alias("verbs"))


def action_verbs_unseen(spark, sf):
    docs = load_wide(spark, sf, "documents", "doc_id", "text").withColumn("_w", tags.tokens("text"))
    return docs.select("doc_id", _joined(tags.unseen_verbs("_w", FORMS)).alias("verbs"))


def skill_match_gap(spark, sf):
    """Documents against the skills of one profile made of all benchmark items. The profile
    side is a set of list words, at most the length of the list."""
    items = load(spark, sf, "benchmark")
    known = each_item(items, tags.profile_skills("text"), [], "w").agg(F.array_sort(F.collect_set("w"))).scalar()
    docs = load_wide(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", tags.keyword_hits("text", lx.POSTING_SKILLS).alias("_job"), known.alias("_known"))
    df = docs.withColumn("_m", tags.matched_skills("_job", "_known")).withColumn("_g", tags.missing_skills("_job", "_known"))
    return df.select("doc_id", _joined("_m").alias("matched"), _joined("_g").alias("missing"),
                     F.size("_m").alias("n_matched"), F.size("_g").alias("n_missing"),
                     F.round(tags.match_ratio("_m", "_job"), 6).alias("ratio"))


HTML_POSTING = f"'<div class=\"x\">' || replace({POSTING}, ', ', ',&nbsp;<b>   </b>') || '</div><script>var a=1;</script>'"


def posting_transform(spark, sf):
    docs = with_body(load_wide(spark, sf, "documents", "doc_id", "text", "source", "lang"))
    raw = docs.select(F.col("doc_id").alias("job_id"), F.col("source").alias("job_title"), F.col("lang").alias("company"),
                      F.lit(None).cast("string").alias("location"), F.expr(over_body(HTML_POSTING)).alias("job_description"),
                      F.lit(None).cast("string").alias("job_url"), F.lit(None).cast("date").alias("date_posted"))
    clean = clean_postings(raw, LEX)
    return clean.select(
        "job_id", "job_title_clean", "company", "description_clean", "summary",
        F.size("qualifications_required").alias("n_required"), F.size("qualifications_bonus").alias("n_bonus"),
        F.size("responsibilities").alias("n_responsibilities"), _joined("extracted_skills").alias("skills"),
        _joined(F.transform(F.array_sort(F.map_entries("entities")),
                            lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], ",")))).alias("entity_names"),
        _joined("action_verbs").alias("verbs"), _joined("domain_tags").alias("domains"))


_DOMAIN_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS d FROM %(src)s WHERE {any_of('lower(%(txt)s)', w)}" for n, w in lx.TAG_DOMAINS.items())


def _agg(x):
    return f"coalesce(string_agg({x}, '|' ORDER BY {x}), '')"


_WHOLE_CHECK = f"""
WITH kw(k) AS (VALUES {text_values(lx.POSTING_SKILLS)}), nm(n, l) AS (VALUES {NAME_ROWS}), fm(f, v) AS (VALUES {FORM_ROWS}),
p AS (SELECT doc_id, source, lang, {check_whitespace(check_html(HTML_POSTING))} AS body FROM documents),
{check_sections(Q_TEST, R_TEST)}, {QUAL_ITEMS}, {RESP_ITEMS},
qc AS (SELECT doc_id, count(*) FILTER (kind = 'required') AS a, count(*) FILTER (kind = 'bonus') AS b FROM qi GROUP BY 1),
rc AS (SELECT doc_id, count(*) AS c FROM rb GROUP BY 1),
tk AS (SELECT doc_id, {TOKENS % 'body'} AS w, ' ' || array_to_string({TOKENS % 'body'}, ' ') || ' ' AS j FROM p),
en AS (SELECT doc_id, l, n FROM tk, nm WHERE contains(j, ' ' || n || ' ')),
el AS (SELECT doc_id, l, l || ':' || string_agg(n, ',' ORDER BY n) AS e FROM en GROUP BY 1, 2),
ea AS (SELECT doc_id, {_agg('e')} AS entity_names FROM el GROUP BY 1),
{_keywords('p', 'body', 'doc_id', 'kd')},
sk AS (SELECT doc_id, w FROM kd UNION SELECT doc_id, n FROM en WHERE l IN ('PRODUCT', 'ORG', 'GPE') AND {any_of('lower(n)', MARKS)}),
sa AS (SELECT doc_id, {_agg('w')} AS skills FROM sk GROUP BY 1),
vb AS (SELECT DISTINCT doc_id, v FROM (SELECT doc_id, lower(unnest(w)) AS t FROM tk) JOIN fm ON t = f),
va AS (SELECT doc_id, {_agg('v')} AS verbs FROM vb GROUP BY 1),
dm AS ({_DOMAIN_ROWS % {'src': 'p', 'txt': 'body'}}),
da AS (SELECT doc_id, {_agg('d')} AS domains FROM dm GROUP BY 1)
SELECT doc_id AS job_id, source AS job_title_clean, lang AS company, body AS description_clean, summary,
       coalesce(a, 0)::INT AS n_required, coalesce(b, 0)::INT AS n_bonus, coalesce(c, 0)::INT AS n_responsibilities,
       coalesce(skills, '') AS skills, coalesce(entity_names, '') AS entity_names, coalesce(verbs, '') AS verbs,
       coalesce(domains, '') AS domains
FROM p JOIN s USING (doc_id) LEFT JOIN qc USING (doc_id) LEFT JOIN rc USING (doc_id) LEFT JOIN sa USING (doc_id)
     LEFT JOIN ea USING (doc_id) LEFT JOIN va USING (doc_id) LEFT JOIN da USING (doc_id)"""

QUERIES = {
    "keyword_skills": (keyword_skills, f"""WITH {KEYWORDS}, {_keywords('documents', 'text', 'doc_id', 'h')}
        SELECT d.doc_id, {_agg('w')} AS skills FROM documents d LEFT JOIN h USING (doc_id) GROUP BY 1"""),
    "keyword_skills_whole_word": (keyword_skills_whole_word, r"""WITH kw(k) AS (VALUES ('in'), ('the'), ('thing'), ('ai'), ('r'), ('est'), ('rest')),
        h AS (SELECT DISTINCT doc_id, regexp_extract(text, '(?i)(?:^|[^0-9A-Za-z_])(' || k || ')(?:$|[^0-9A-Za-z_])', 1) AS w FROM documents, kw)
        SELECT d.doc_id, coalesce(string_agg(w, '|' ORDER BY w) FILTER (w <> ''), '') AS skills FROM documents d LEFT JOIN h USING (doc_id) GROUP BY 1"""),
    "profile_skills": (profile_skills, f"""WITH kw(k, i) AS (VALUES {PROFILE_WORDS})
        SELECT item_id, coalesce(string_agg(k, '|' ORDER BY i) FILTER (contains(lower(text), k)), '') AS skills FROM benchmark, kw GROUP BY 1"""),
    "domain_tags": (domain_tags, f"""WITH p AS (SELECT doc_id, {POSTING} AS body FROM documents), dm AS ({_DOMAIN_ROWS % {'src': 'p', 'txt': 'body'}})
        SELECT p.doc_id, {_agg('d')} AS domains FROM p LEFT JOIN dm USING (doc_id) GROUP BY 1"""),
    "entity_map": (entity_map, f"""WITH nm(n, l) AS (VALUES {NAME_ROWS}),
        tk AS (SELECT doc_id, ' ' || array_to_string({TOKENS % 'text'}, ' ') || ' ' AS j FROM documents)
        SELECT doc_id, l AS label, {_agg('n')} AS names FROM tk, nm WHERE contains(j, ' ' || n || ' ') GROUP BY 1, 2"""),
    "entity_gazetteer": (entity_gazetteer, f"""WITH g AS (SELECT DISTINCT unnest({TOKENS % 'text'}) AS n FROM benchmark),
        t AS (SELECT DISTINCT doc_id, unnest({TOKENS % 'text'}) AS n FROM documents)
        SELECT doc_id, CASE WHEN length(n) % 2 = 0 THEN 'even' ELSE 'odd' END AS label, {_agg('n')} AS names FROM t JOIN g USING (n) GROUP BY 1, 2"""),
    "entity_gazetteer_long": (entity_gazetteer_long, rf"""WITH w AS (SELECT string_split(text, ' ') AS w FROM benchmark),
        r AS (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, range(1, 7) k(n)),
        g AS (SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS name, 'words ' || n AS label FROM r),
        gr AS (SELECT name, label, {TOKENS % 'name'} AS k, array_to_string({TOKENS % 'name'}, ' ') AS run FROM g),
        lens AS (SELECT DISTINCT len(k) AS n FROM gr WHERE len(k) > 0),
        tk AS (SELECT doc_id, {TOKENS % 'text'} AS k FROM documents),
        p AS (SELECT doc_id, k, n, unnest(range(1, len(k) - n + 2)) AS i FROM tk, lens),
        t AS (SELECT DISTINCT doc_id, array_to_string(k[i:i + n - 1], ' ') AS run FROM p),
        h AS (SELECT doc_id, label, name FROM t JOIN gr USING (run) JOIN documents d USING (doc_id)
            WHERE name = run OR (contains(d.text, name) AND regexp_matches(d.text, '(^|[^\p{{L}}\p{{N}}])' || regexp_escape(name) || '($|[^\p{{L}}\p{{N}}])')
                OR (contains(d.text, name) AND NOT regexp_matches(name, '[\p{{L}}\p{{N}}]$') AND regexp_matches(d.text, '(^|[^\p{{L}}\p{{N}}])' || regexp_escape(name)))))
        SELECT doc_id, label, {_agg('name')} AS names FROM h GROUP BY 1, 2"""),
    "action_verbs": (action_verbs, f"""WITH fm(f, v) AS (VALUES {FORM_ROWS}),
        t AS (SELECT DISTINCT doc_id, lower(unnest({TOKENS % 'text'})) AS f FROM documents), h AS (SELECT DISTINCT doc_id, v FROM t JOIN fm USING (f))
        SELECT d.doc_id, {_agg('v')} AS verbs FROM documents d LEFT JOIN h USING (doc_id) GROUP BY 1"""),
    "action_verbs_unseen": (action_verbs_unseen, f"""WITH ex(f, v) AS (VALUES {EXCEPTION_ROWS}), fm(f, v) AS (VALUES {FORM_ROWS}),
        t AS (SELECT DISTINCT doc_id, lower(unnest({TOKENS % 'text'})) AS w FROM documents),
        l AS (SELECT doc_id, w, CASE {VERB_CASES} END AS v FROM t WHERE regexp_matches(w, '(?:ing|ed)$') AND w NOT IN (SELECT f FROM fm)),
        h AS (SELECT DISTINCT doc_id, CASE WHEN ex.f IS NOT NULL THEN nullif(ex.v, '') WHEN regexp_matches(l.v, '[aeiouy]') AND length(l.v) >= 3 THEN l.v END AS v
            FROM l LEFT JOIN ex ON ex.f = l.w)
        SELECT d.doc_id, coalesce(string_agg(v, '|' ORDER BY v) FILTER (v IS NOT NULL), '') AS verbs FROM documents d LEFT JOIN h USING (doc_id) GROUP BY 1"""),
    "skill_match_gap": (skill_match_gap, f"""WITH {KEYWORDS}, pw(k, i) AS (VALUES {PROFILE_WORDS}), {_keywords('documents', 'text', 'doc_id', 'h')},
        known AS (SELECT DISTINCT k FROM benchmark, pw WHERE contains(lower(text), k)),
        m AS (SELECT doc_id, w, lower(w) IN (SELECT k FROM known) AS ok FROM h)
        SELECT d.doc_id, coalesce(string_agg(w, '|' ORDER BY w) FILTER (ok), '') AS matched,
               coalesce(string_agg(w, '|' ORDER BY w) FILTER (NOT ok), '') AS missing,
               (count(*) FILTER (ok))::INT AS n_matched, (count(*) FILTER (NOT ok))::INT AS n_missing,
               CASE WHEN count(w) = 0 THEN 0.0 ELSE round((count(*) FILTER (ok))::DOUBLE / count(w), 6) END AS ratio
        FROM documents d LEFT JOIN m USING (doc_id) GROUP BY 1"""),
    "posting_transform": (posting_transform, _WHOLE_CHECK),
}
