"""Vectors, matches, ranks and composite scores."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from fitlens import lexicon as lx
from fitlens.catalog.parsing import QUAL_ITEMS, RESP_ITEMS, SECTIONS
from fitlens.catalog.shared import load, load_wide, postings
from fitlens.catalog.tagging import KEYWORDS, PROFILE_WORDS, _keywords
from fitlens.functions import tags
from fitlens.functions.sections import parse_description
from fitlens.functions.vectors import cosine, embed_text
from fitlens.operators.agreement import kendall_tau
from fitlens.operators.evaluate import composite, good_fit, ranking_quality, weight_grid
from fitlens.operators.match import OVERALL, explode_matches, match_profile
from fitlens.operators.rows import dropped, each_item, released, small_side, stored, written
from fitlens.operators.rank import global_rank, top_rows
from fitlens.plans.embed import posting_sections
from fitlens.plans.score import rank_postings, score_postings, with_unscored
from fitlens.sources.exports import summary
from fitlens.sources.profile import parse_sections, profile_rows, technical_skills_text

DIM = 64
PER_SECTION = {"TechnicalSkills": 1, "Projects": 3, "Summary": 2}
GRID = [{"own": 1.0}, {"overall": 1.0}, {"own": 0.5, "overall": 0.5}, {"own": 0.9, "overall": 0.1}]


def _mean_vectors(df, *group):
    """Mean vector per group: partial sums per position, so no group of vectors is gathered."""
    parts = each_item(df, "embedding", group, "v").groupBy(*group, "pos").agg(
        F.avg(F.col("v").cast("double")).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return parts.groupBy(*group).agg(F.transform(ordered, lambda x: x["v"]).alias("embedding"))


def _embeddings(spark, sf):
    return load_wide(spark, sf, "embeddings", "vec_id", "embedding", "label")


def _overall_profile(vectors):
    return _mean_vectors(vectors).select(F.lit(0).alias("ordinal"), F.lit(OVERALL).alias("section"), "embedding")


def _document_vectors(spark, sf):
    docs = load_wide(spark, sf, "documents", "doc_id", "text")
    return docs.select(F.col("doc_id").alias("job_id"), embed_text("text", dim=DIM).alias("embedding"))


def _benchmark_profile(spark, sf):
    """One profile: a row per benchmark item and, in front, the mean of all of them."""
    items = load(spark, sf, "benchmark").select(
        F.lit("items").alias("profile_version"), (F.col("item_id") + 1).cast("int").alias("ordinal"),
        F.element_at(F.array(*[F.lit(s) for s in PER_SECTION]), (F.col("item_id") % 3 + 1).cast("int")).alias("section"),
        F.lit(None).cast("string").alias("subsection"), F.lit("content").alias("content_type"),
        F.substring("text", 1, lx.STORED_TEXT_CHARS).alias("text"), F.col("text").alias("full_text"),
        embed_text("text", dim=DIM).alias("embedding"))
    whole = _mean_vectors(items).select(
        F.lit("items").alias("profile_version"), F.lit(0).alias("ordinal"), F.lit(OVERALL).alias("section"),
        F.lit(None).cast("string").alias("subsection"), F.lit("full_resume").alias("content_type"),
        F.lit("").alias("text"), F.lit("").alias("full_text"), F.col("embedding").cast("array<float>").alias("embedding"))
    return items.unionByName(whole)


def hashed_embedding(spark, sf):
    vectors = each_item(_document_vectors(spark, sf), "embedding", ["job_id"], "v")
    return vectors.filter("v > 0").select("job_id", "pos", F.round(F.col("v").cast("double"), 6).alias("v"))


def cosine_pairs(spark, sf):
    vectors = _embeddings(spark, sf)
    own = _mean_vectors(vectors, "label").withColumnRenamed("embedding", "centre")
    return vectors.join(small_side(own, 10_000), "label").select("vec_id", F.round(cosine("embedding", "centre"), 6).alias("similarity"))


def overall_similarity(spark, sf):
    vectors = _embeddings(spark, sf)
    scored = match_profile(vectors, _overall_profile(vectors), 1)
    return scored.select("vec_id", F.round("overall_similarity", 6).alias("similarity"))


def topk_matches(spark, sf):
    scored = match_profile(_document_vectors(spark, sf), _benchmark_profile(spark, sf), 5)
    return explode_matches(scored).select("job_id", "position", "ordinal", "section",
                                          F.round("similarity", 6).alias("similarity"))


def match_large_profile(spark, sf):
    """Documents against the sentences of all documents: both sides grow with the table."""
    docs = load_wide(spark, sf, "documents", "doc_id", "text")
    sentences = each_item(docs, F.split("text", "[.] "), ["doc_id"], "text")
    texts = []
    numbered = global_rank(sentences, ["doc_id", "pos"], rank_col="ordinal", keep=partial(written, folders=texts))
    released(spark)
    profile = numbered.select(F.lit("sentences").alias("profile_version"), F.col("ordinal").cast("int").alias("ordinal"),
                              F.lit("Projects").alias("section"), embed_text("text", dim=DIM).alias("embedding"))
    scored = match_profile(_document_vectors(spark, sf), profile, 3, kept=partial(dropped, spark, texts))
    return explode_matches(scored).select("job_id", "position", "ordinal", F.round("similarity", 6).alias("similarity"))


def topk_per_section(spark, sf):
    scored = match_profile(_document_vectors(spark, sf), _benchmark_profile(spark, sf), per_section=PER_SECTION)
    return explode_matches(scored).select("job_id", "section", "ordinal", F.round("similarity", 6).alias("similarity"))


def _overall_scores(spark, sf):
    vectors = _embeddings(spark, sf)
    scored = match_profile(vectors, _overall_profile(vectors), 1)
    return scored.select("vec_id", "label", "overall_similarity").withColumn("composite_score", composite())


def composite_rank(spark, sf):
    ranked = global_rank(_overall_scores(spark, sf), [F.desc("composite_score"), "vec_id"])
    return ranked.select("vec_id", "rank", F.round("composite_score", 6).alias("score"))


def top_match(spark, sf):
    top = top_rows(_overall_scores(spark, sf), [F.desc("composite_score"), "vec_id"], 5)
    return top.select("vec_id", F.round("composite_score", 6).alias("score"))


def multi_profile_rank(spark, sf):
    vectors = _embeddings(spark, sf)
    profiles = _mean_vectors(vectors, "label").select(
        F.concat(F.lit("v"), F.col("label")).alias("profile_version"), F.lit(0).alias("ordinal"),
        F.lit(OVERALL).alias("section"), "embedding")
    scored = match_profile(vectors.select("vec_id", "embedding"), profiles, 1)
    ranked = global_rank(scored.drop("matches"), [F.desc("overall_similarity"), "vec_id"], group=["profile_version"])
    return ranked.select("profile_version", "vec_id", "rank", F.round("overall_similarity", 6).alias("score"))


def _component_scores(spark, sf):
    vectors = _embeddings(spark, sf)
    own = _mean_vectors(vectors, "label").withColumnRenamed("embedding", "centre")
    scored = match_profile(vectors, _overall_profile(vectors), 1, vector="embedding").select(
        "vec_id", F.round("overall_similarity", 9).alias("overall"))
    return vectors.join(small_side(own, 10_000), "label").select("vec_id", F.round(cosine("embedding", "centre"), 9).alias("own")).join(scored, "vec_id")


def fit_flag(spark, sf):
    scores = _component_scores(spark, sf).withColumn("score", composite({"own": 0.6, "overall": 0.4}))
    return scores.select("vec_id", F.round("score", 6).alias("score"), good_fit("score", 0.2).alias("is_fit"))


def weight_search(spark, sf):
    best = weight_grid(_component_scores(spark, sf), GRID, "vec_id", "vec_id")
    return best.select("point", F.round("rank_correlation", 6).alias("rank_correlation"))


def score_agreement(spark, sf):
    """Kendall's tau-b of the two similarities, as they are and in steps with many ties."""
    scores = _component_scores(spark, sf).withColumns({"own_step": F.round("own", 1), "overall_step": F.round("overall", 1)})
    scores = stored(scores)
    pairs = (("own", "overall"), ("own_step", "overall"), ("own_step", "overall_step"))
    found = [(a, b, kendall_tau(scores, a, b)) for a, b in pairs]
    return spark.createDataFrame(found, "a string, b string, tau double").select("a", "b", F.round("tau", 6).alias("tau"))


def profile_document_rows(spark, sf):
    items = load(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("profile_version"),
        F.expr("to_json(named_struct('Name', 'skipped', 'Summary', array(named_struct('SourceResume', 'x', 'Content', text)), "
               "'Projects', array(named_struct('Subsection', 'Item ' || item_id, 'Bullet', split(text, '[.] ')))))").alias("doc"))
    profiles = items.select("profile_version", parse_sections(F.col("doc")).alias("sections"))
    return profile_rows(profiles, lx.STORED_TEXT_CHARS)


def first_skills_row(spark, sf):
    return technical_skills_text(_benchmark_profile(spark, sf)).select("profile_version", "text")


def _scored_documents(spark, sf):
    return _scored(spark, sf)[1]


def _scored(spark, sf, processed=None):
    """Documents as raw postings, and the scores of those that are ``processed``, or of all."""
    docs = load_wide(spark, sf, "documents", "doc_id", "text", "source", "lang")
    raw = docs.select(F.col("doc_id").alias("job_id"), F.col("source").alias("company"), F.col("lang").alias("job_title"),
                      F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("job_url"),
                      F.lit(None).cast("date").alias("date_posted"))
    clean = docs.select(F.col("doc_id").alias("job_id"), tags.keyword_hits("text", lx.POSTING_SKILLS).alias("extracted_skills"))
    vectors = docs.select(F.col("doc_id").alias("job_id"), F.lit("full_description").alias("section"),
                          embed_text("text", dim=DIM).alias("embedding"))
    return raw, score_postings(raw, clean.join(docs.filter(processed).select(F.col("doc_id").alias("job_id")), "job_id", "left_semi")
                               if processed is not None else clean, vectors, _benchmark_profile(spark, sf))


def unscored_postings(spark, sf):
    """Only the English documents are processed; the others are listed without a score."""
    raw, scored = _scored(spark, sf, F.col("lang") == "en")
    return with_unscored(raw, scored).select(
        "job_id", "company", "job_title", "profile_version", F.round("composite_score", 6).alias("score"),
        F.size("matched_skills").alias("n_matched"), "skill_gap_count")


def score_and_rank(spark, sf):
    ranked = rank_postings(_scored_documents(spark, sf))
    return ranked.select(
        "job_id", "company", "rank", F.round("composite_score", 6).alias("score"), "skill_match_count", "skill_gap_count",
        F.round("skill_match_ratio", 6).alias("ratio"),
        F.array_join(F.transform("best_resume_matches", lambda m: m["ordinal"].cast("string")), "|").alias("best"))


def weighted_composite(spark, sf):
    """Postings parsed, embedded and scored by the four declared weights. The parse and the vectors have
    several readers, so each is computed once."""
    docs = postings(spark, sf).select(F.col("doc_id").alias("job_id"), F.col("body").alias("description_clean"))
    clean = written(parse_description(docs, "description_clean").withColumn(
        "extracted_skills", tags.keyword_hits("description_clean", lx.POSTING_SKILLS)))
    texts = posting_sections(clean).filter(F.col("section").isin("full_description", "responsibilities"))
    vectors = written(texts.select("job_id", "section", embed_text("text", dim=DIM).alias("embedding")))
    none = F.lit(None).cast("string")
    raw = docs.select("job_id", *[none.alias(c) for c in ("company", "job_title", "location", "job_url")], none.cast("date").alias("date_posted"))
    scored = score_postings(raw, clean, vectors, _benchmark_profile(spark, sf), weights=lx.SCORE_WEIGHTS)
    return scored.select("job_id", F.round("composite_score", 6).alias("score"), F.round("overall_similarity", 6).alias("overall"))


def summary_export(spark, sf):
    out = summary(rank_postings(_scored_documents(spark, sf)))
    return out.select("rank", "company", "job_title", "location", "skill_match_count", "skill_gap_count", "job_url",
                      F.col("date_posted").cast("string").alias("date_posted"),
                      F.round("composite_score", 6).alias("composite_score"),
                      F.round("overall_similarity", 6).alias("overall_similarity"))


def ranking_metrics(spark, sf):
    stats = ranking_quality(_scored_documents(spark, sf))
    quartiles = [F.round(F.col("quartiles")[k], 6).alias(name) for k, name in enumerate(("first_quartile", "median", "third_quartile"))]
    return stats.select(*[F.round(c, 6).alias(c) for c in stats.columns if c != "quartiles"], *quartiles)


def _hash_check(src, key, text, p):
    return rf"""{p}_t AS (SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')) AS t FROM {src}),
{p}_b AS (SELECT id, (('0x' || substr(md5(t), 1, 8))::BIGINT % {DIM})::INT AS b, count(*) AS n FROM {p}_t GROUP BY 1, 2),
{p}_n AS (SELECT id, sqrt(sum(n * n)::DOUBLE) AS len FROM {p}_b GROUP BY 1),
{p}_v AS (SELECT id, b, (n / len)::FLOAT AS v FROM {p}_b JOIN {p}_n USING (id)),
{p}_e AS (SELECT s.{key} AS id, list(coalesce(v.v, 0)::DOUBLE ORDER BY r.b) AS e
          FROM {src} s CROSS JOIN range({DIM}) r(b) LEFT JOIN {p}_v v ON v.id = s.{key} AND v.b = r.b GROUP BY 1)"""


def _cos(a, b):
    return f"round(greatest(0.0, least(1.0, coalesce(nullif(list_cosine_similarity({a}, {b}), 'nan'::DOUBLE), 0.0))), 12)"


_SECTION_OF = "CASE item_id % 3 WHEN 0 THEN 'TechnicalSkills' WHEN 1 THEN 'Projects' ELSE 'Summary' END"
_PROFILE_CHECK = f"""{_hash_check('documents', 'doc_id', 'text', 'd')}, {_hash_check('benchmark', 'item_id', 'text', 'k')},
mean AS (SELECT list(m ORDER BY i) AS e FROM (SELECT i, avg(v)::FLOAT::DOUBLE AS m FROM (
    SELECT unnest(e) AS v, generate_subscripts(e, 1) AS i FROM k_e) GROUP BY i)),
prof AS (SELECT (id + 1)::INT AS ordinal, {_SECTION_OF.replace('item_id', 'id')} AS section, e FROM k_e
         UNION ALL SELECT 0, 'overall_resume', e FROM mean),
sim AS (SELECT d_e.id AS job_id, ordinal, section, {_cos('d_e.e', 'prof.e')} AS s FROM d_e CROSS JOIN prof)"""
_CENTRES = """x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, label, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM x),
own AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM u GROUP BY 1, 2) GROUP BY 1),
whole AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(v) AS m FROM u GROUP BY 1))"""
_COMPONENTS = f"""WITH {_CENTRES}, sc AS (SELECT vec_id, round({_cos('x.e', 'own.c')}, 9) AS own, round({_cos('x.e', 'whole.c')}, 9) AS overall
    FROM x JOIN own USING (label) CROSS JOIN whole)"""
_RANKED = f"""WITH {KEYWORDS}, pw(k, i) AS (VALUES {PROFILE_WORDS}), {_PROFILE_CHECK}, {_keywords('documents', 'text', 'doc_id', 'h')},
known AS (SELECT k FROM pw, benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark WHERE item_id % 3 = 0) AND contains(lower(text), k)),
m AS (SELECT doc_id, count(*) FILTER (lower(w) IN (SELECT k FROM known)) AS hit, count(*) AS n FROM h GROUP BY 1),
best AS (SELECT job_id, string_agg(ordinal::VARCHAR, '|' ORDER BY rn) AS best FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY s DESC, ordinal) AS rn FROM sim) WHERE rn <= 5 GROUP BY 1),
fin AS (SELECT job_id, source AS company, lang AS job_title, s, row_number() OVER (ORDER BY s DESC, job_id) AS rank,
    coalesce(hit, 0)::INT AS skill_match_count, (coalesce(n, 0) - coalesce(hit, 0))::INT AS skill_gap_count,
    CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE round(hit::DOUBLE / n, 6) END AS ratio, best
    FROM sim JOIN documents d ON d.doc_id = job_id LEFT JOIN m ON m.doc_id = job_id JOIN best USING (job_id) WHERE section = 'overall_resume')"""

QUERIES = {
    "hashed_embedding": (hashed_embedding, f"WITH {_hash_check('documents', 'doc_id', 'text', 'd')} "
                         "SELECT id AS job_id, b AS pos, round(v::DOUBLE, 6) AS v FROM d_v WHERE v > 0"),
    "cosine_pairs": (cosine_pairs, f"WITH {_CENTRES} SELECT vec_id, round({_cos('x.e', 'own.c')}, 6) AS similarity FROM x JOIN own USING (label)"),
    "overall_similarity": (overall_similarity, f"WITH {_CENTRES} SELECT vec_id, round({_cos('x.e', 'whole.c')}, 6) AS similarity FROM x CROSS JOIN whole"),
    "topk_matches": (topk_matches, f"""WITH {_PROFILE_CHECK}
        SELECT job_id, rn::INT AS position, ordinal, section, round(s, 6) AS similarity FROM (
            SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY s DESC, ordinal) AS rn FROM sim) WHERE rn <= 5"""),
    "match_large_profile": (match_large_profile, f"""WITH p AS (SELECT doc_id, unnest(string_split(text, '. ')) AS text, generate_subscripts(string_split(text, '. '), 1) AS i FROM documents),
        n AS (SELECT row_number() OVER (ORDER BY doc_id, i) AS ordinal, text FROM p),
        {_hash_check('documents', 'doc_id', 'text', 'd')}, {_hash_check('n', 'ordinal', 'text', 's')},
        sim AS (SELECT d_e.id AS job_id, s_e.id AS ordinal, {_cos('d_e.e', 's_e.e')} AS s FROM d_e CROSS JOIN s_e)
        SELECT job_id, rn::INT AS position, ordinal::INT AS ordinal, round(s, 6) AS similarity FROM (
            SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY s DESC, ordinal) AS rn FROM sim) WHERE rn <= 3"""),
    "topk_per_section": (topk_per_section, f"""WITH {_PROFILE_CHECK}
        SELECT job_id, section, ordinal, round(s, 6) AS similarity FROM (
            SELECT *, row_number() OVER (PARTITION BY job_id, section ORDER BY s DESC, ordinal) AS rn FROM sim)
        WHERE rn <= CASE section WHEN 'TechnicalSkills' THEN 1 WHEN 'Projects' THEN 3 WHEN 'Summary' THEN 2 ELSE 0 END"""),
    "composite_rank": (composite_rank, f"""WITH {_CENTRES}, sc AS (SELECT vec_id, {_cos('x.e', 'whole.c')} AS s FROM x CROSS JOIN whole)
        SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank, round(s, 6) AS score FROM sc"""),
    "top_match": (top_match, f"""WITH {_CENTRES}, sc AS (SELECT vec_id, {_cos('x.e', 'whole.c')} AS s FROM x CROSS JOIN whole)
        SELECT vec_id, round(s, 6) AS score FROM sc ORDER BY s DESC, vec_id LIMIT 5"""),
    "multi_profile_rank": (multi_profile_rank, f"""WITH {_CENTRES},
        sc AS (SELECT 'v' || own.label AS profile_version, vec_id, {_cos('x.e', 'own.c')} AS s FROM x CROSS JOIN own)
        SELECT profile_version, vec_id, row_number() OVER (PARTITION BY profile_version ORDER BY s DESC, vec_id) AS rank, round(s, 6) AS score FROM sc"""),
    "fit_flag": (fit_flag, f"{_COMPONENTS} SELECT vec_id, round(own * 0.6 + overall * 0.4, 6) AS score, own * 0.6 + overall * 0.4 >= 0.2 AS is_fit FROM sc"),
    "score_agreement": (score_agreement, f"""{_COMPONENTS}, v AS (SELECT vec_id, own, overall, round(own, 1) AS own_step, round(overall, 1) AS overall_step FROM sc),
        p AS (SELECT sign(x.own - y.own) AS a, sign(x.overall - y.overall) AS b, sign(x.own_step - y.own_step) AS c, sign(x.overall_step - y.overall_step) AS d
              FROM v x, v y WHERE x.vec_id < y.vec_id)
        SELECT 'own' AS a, 'overall' AS b, round(sum(a * b) / sqrt(sum(abs(a))) / sqrt(sum(abs(b))), 6) AS tau FROM p
        UNION ALL SELECT 'own_step', 'overall', round(sum(c * b) / sqrt(sum(abs(c))) / sqrt(sum(abs(b))), 6) FROM p
        UNION ALL SELECT 'own_step', 'overall_step', round(sum(c * d) / sqrt(sum(abs(c))) / sqrt(sum(abs(d))), 6) FROM p"""),
    "weight_search": (weight_search, f"""{_COMPONENTS}, g(point, a, b) AS (VALUES (0, 1.0, 0.0), (1, 0.0, 1.0), (2, 0.5, 0.5), (3, 0.9, 0.1)),
        r AS (SELECT point, vec_id, row_number() OVER (PARTITION BY point ORDER BY a::DOUBLE * own + b::DOUBLE * overall DESC, vec_id) AS rank FROM sc CROSS JOIN g)
        SELECT point, round(corr(rank, vec_id), 6) AS rank_correlation FROM r GROUP BY 1"""),
    "profile_document_rows": (profile_document_rows, """WITH b AS (SELECT item_id::VARCHAR AS profile_version, text, 'Item ' || item_id AS sub, string_split(text, '. ') AS bl FROM benchmark),
        r AS (SELECT profile_version, 0 AS ordinal, 'overall_resume' AS section, NULL AS subsection, 'full_resume' AS content_type,
                     text || ' ' || sub || ' ' || array_to_string(bl, ' ') AS t FROM b
              UNION ALL SELECT profile_version, 1, 'Summary', NULL, 'content', text FROM b
              UNION ALL SELECT profile_version, 2, 'Projects', sub, 'subsection', sub || ' ' || array_to_string(bl, ' ') FROM b
              UNION ALL SELECT profile_version, (2 + generate_subscripts(bl, 1))::INT, 'Projects', sub, 'bullet', unnest(bl) FROM b)
        SELECT profile_version, ordinal, section, subsection, content_type, substr(t, 1, 500) AS text FROM r"""),
    "first_skills_row": (first_skills_row, """SELECT 'items' AS profile_version, arg_min(text, item_id) AS text FROM benchmark WHERE item_id % 3 = 0"""),
    "score_and_rank": (score_and_rank, f"{_RANKED} SELECT job_id, company, rank, round(s, 6) AS score, skill_match_count, skill_gap_count, ratio, best FROM fin"),
    "unscored_postings": (unscored_postings, f"""{_RANKED} SELECT d.doc_id AS job_id, d.source AS company, d.lang AS job_title,
        CASE WHEN lang = 'en' THEN 'items' END AS profile_version, CASE WHEN lang = 'en' THEN round(s, 6) END AS score,
        CASE WHEN lang = 'en' THEN skill_match_count END AS n_matched, CASE WHEN lang = 'en' THEN skill_gap_count END AS skill_gap_count
        FROM documents d LEFT JOIN fin ON job_id = d.doc_id"""),
    "weighted_composite": (weighted_composite, f"""{SECTIONS}, {QUAL_ITEMS}, {RESP_ITEMS}, pw(k, i) AS (VALUES {PROFILE_WORDS}),
        known AS (SELECT k FROM pw, benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark WHERE item_id % 3 = 0) AND contains(lower(text), k)),
        m AS (SELECT doc_id, kind, avg(CASE WHEN EXISTS (SELECT 1 FROM known WHERE contains(lower(item), k)) THEN 1.0 ELSE 0.0 END) AS m FROM qi GROUP BY 1, 2),
        r AS (SELECT doc_id, string_agg(txt, ' ' ORDER BY o) AS t FROM rb GROUP BY 1 HAVING string_agg(txt, ' ' ORDER BY o) <> ''),
        {_hash_check('p', 'doc_id', 'body', 'd')}, {_hash_check('r', 'doc_id', 't', 'a')}, {_hash_check('benchmark', 'item_id', 'text', 'k')},
        mean AS (SELECT list(m ORDER BY i) AS e FROM (SELECT i, avg(v)::FLOAT::DOUBLE AS m FROM (
            SELECT unnest(e) AS v, generate_subscripts(e, 1) AS i FROM k_e) GROUP BY i)),
        f AS (SELECT d_e.id, {_cos('d_e.e', 'mean.e')} AS s, coalesce({_cos('a_e.e', 'mean.e')}, 0) AS al FROM d_e LEFT JOIN a_e USING (id) CROSS JOIN mean)
        SELECT f.id AS job_id, round(0.4::DOUBLE * s + 0.3::DOUBLE * coalesce(q.m, 0) + 0.2::DOUBLE * al + 0.1::DOUBLE * coalesce(b.m, 0), 6) AS score, round(s, 6) AS overall
        FROM f LEFT JOIN m q ON q.doc_id = f.id AND q.kind = 'required' LEFT JOIN m b ON b.doc_id = f.id AND b.kind = 'bonus'"""),
    "summary_export": (summary_export, f"""{_RANKED} SELECT rank, company, job_title, NULL::VARCHAR AS location, skill_match_count, skill_gap_count,
        NULL::VARCHAR AS job_url, NULL::VARCHAR AS date_posted, round(s, 6) AS composite_score, round(s, 6) AS overall_similarity FROM fin"""),
    "ranking_metrics": (ranking_metrics, f"""{_RANKED} SELECT round(min(s), 6) AS min_score, round(max(s), 6) AS max_score, round(avg(s), 6) AS avg_score,
        round(stddev_samp(s), 6) AS sd_score, round(corr(skill_match_count::DOUBLE, s), 6) AS skill_correlation,
        round(quantile_cont(s, 0.25), 6) AS first_quartile, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.75), 6) AS third_quartile FROM fin"""),
}
