"""Intake, joins, deduplication, constraints and statistics."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from fitlens.catalog.shared import load, load_wide
from fitlens.operators import dedup, evaluate, quality
from fitlens.operators.learn import fit_logistic
from fitlens.operators.rank import top_rows
from fitlens.plans.run import classify_intake
from fitlens.sources import tables
from fitlens.sources.exports import decode_nested, encode_nested
from fitlens.sources.postings import coerce_date, normalize_postings, parse_postings

AS_OF = datetime.date(2026, 1, 2)

RAW_JSON = """CASE event_id % 6
WHEN 0 THEN to_json(named_struct('title', event_type, 'company', '', 'company_name', 'u' || user_id, 'description', props,
                                 'date_posted', unix_millis(cast(ts AS timestamp))))
WHEN 1 THEN to_json(named_struct('job_title', event_type, 'company', 'u' || user_id, 'job_description', props, 'location', '',
                                 'job_location', 'L' || user_id % 7, 'date_posted', date_format(ts, 'yyyy-MM-dd') || 'T23:30:00-07:00'))
WHEN 2 THEN '[' || to_json(named_struct('position', event_type, 'company_name', 'u' || user_id, 'job_details', props,
                                        'salary', user_id + 1, 'date_posted', 0, 'posted_date', date_format(ts, 'yyyy-MM-dd') || 'T01:00:00Z')) || ']'
WHEN 3 THEN to_json(named_struct('title', 0, 'company', false, 'description', '', 'date_posted', 'soon'))
WHEN 4 THEN '[7]' ELSE '{bad' || props END"""


def posting_intake(spark, sf):
    files = load_wide(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "props").select(
        F.col("event_id").cast("string").alias("file"), F.expr(RAW_JSON).alias("value"))
    rows = normalize_postings(parse_postings(files), "manual", AS_OF)
    return rows.select("file", "reason", "job_title", "company", "location", "job_description", "salary_range",
                       F.col("date_posted").cast("string").alias("date_posted"), "source")


def date_coerce(spark, sf):
    orders = load(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.col("o_orderkey") % 7
    text = (F.when(kind == 0, F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string"))
            .when(kind == 1, day).when(kind == 2, F.concat(day, F.lit("T23:30:00-07:00")))
            .when(kind == 3, F.concat(day, F.lit("T01:00:00Z"))).when(kind == 4, F.substring(day, 1, 7))
            .when(kind == 5, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("soon"))
    date = coerce_date(text, kind == 0, F.lit(AS_OF))
    return orders.select("o_orderkey", date.cast("string").alias("day"))


def json_extract(spark, sf):
    events = load(spark, sf, "events")
    parsed = decode_nested(events, {"props": "struct<k:int>"})
    per_type = parsed.groupBy("event_type").agg(F.sum("props.k").alias("sum_k"), F.count("props.k").alias("n"))
    coded = encode_nested(per_type.withColumn("packed", F.struct("sum_k", "n")), ["packed"])
    return coded.select("event_type", "packed")


def _intake_frames(spark, sf):
    events = load(spark, sf, "events")
    postings = events.select(
        F.col("event_type").alias("file"), F.col("event_id").alias("pos"),
        F.when(F.col("value") < 2, "missing_description").alias("reason"),
        F.concat(F.lit("u"), F.col("user_id")).alias("company"), F.concat(F.lit("T"), F.col("user_id") % 3).alias("job_title"),
        F.to_date("ts").alias("date_posted"))
    known = postings.filter("file = 'signup'").select("company", "job_title", "date_posted").distinct()
    return postings, known


def ingest_stats_rollup(spark, sf):
    return quality.outcome_rollup(classify_intake(*_intake_frames(spark, sf)))


def anti_join_new(spark, sf):
    postings, known = _intake_frames(spark, sf)
    fresh = dedup.only_new(dedup.keep_first(postings.filter("reason is null"), ["file", "pos"]), known)
    return fresh.select("file", "pos", "company", "job_title", F.col("date_posted").cast("string").alias("date_posted"))


def dedup_keep_first(spark, sf):
    first = dedup.keep_first(load(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value"),
                             ["ts", "event_id"], ["user_id", "event_type"])
    return first.select("user_id", "event_type", "event_id", "value")


def dedup_exact_text(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text", "source")
    return dedup.keep_first_text(docs, "text", "doc_id").select("doc_id", "source")


def dedup_ignore_case(spark, sf):
    parts = load(spark, sf, "part").select(
        "p_partkey", F.expr("CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) || ' ' ELSE p_name END").alias("name"), "p_brand")
    return dedup.keep_first(parts, ["p_partkey"], dedup.folded(["name", "p_brand"])).select("p_partkey", "name", "p_brand")


def left_join_meta(spark, sf):
    customers = load(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return orders.join(customers, "o_custkey", "left").filter("o_orderstatus = 'F'")


def inner_lookup(spark, sf):
    customers = load(spark, sf, "customer").select("c_custkey", "c_name", F.array("c_mktsegment", F.lit("any")).alias("_tags"))
    orders = load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return orders.join(customers, "c_custkey").select(
        "o_orderkey", "c_name", F.array_join(F.transform("_tags", F.lower), "|").alias("tags"))


def processed_flag(spark, sf):
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), "o_orderstatus")
    done = load(spark, sf, "lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("job_id"))
    return tables.with_processed_flag(orders, done)


def status_counts(spark, sf):
    return quality.status_counts(load(spark, sf, "orders"), F.col("o_orderstatus") == "F")


def outcome_counts(spark, sf):
    outcome = F.when(F.col("value") < 2, "errors").otherwise("processed").alias("outcome")
    return quality.outcome_counts(load(spark, sf, "events").select(outcome))


def unique_violations(spark, sf):
    return quality.unique_violations(load(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"])


def orphan_rows(spark, sf):
    parents = load(spark, sf, "customer").filter("c_acctbal >= 0")
    return quality.orphans(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), parents, "o_custkey", "c_custkey")


def length_violations(spark, sf):
    docs = load_wide(spark, sf, "documents", "doc_id", "text", "source", "lang").select(
        "doc_id", F.when(F.col("lang") != "es", F.col("text")).alias("text"), "source")
    return quality.constraint_violations(docs, ["text"], {"text": 2000, "source": 4}).select("doc_id", "reason")


def unprocessed_latest(spark, sf):
    orders = load(spark, sf, "orders").filter("o_orderstatus <> 'F'")
    return orders.orderBy(F.desc("o_orderdate"), "o_orderkey").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def unprocessed_postings(spark, sf):
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.to_date("o_orderdate").alias("date_posted"))
    done = load(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("job_id"))
    return tables.unprocessed(orders, done).select("job_id", F.col("date_posted").cast("string").alias("day"))


def top_head(spark, sf):
    return top_rows(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"])


def first_per_section(spark, sf):
    vectors = load(spark, sf, "embeddings")
    return vectors.filter("label >= 0").groupBy("label").agg(F.min_by(F.element_at("embedding", 1).cast("double"), "vec_id").alias("v")).select(
        "label", F.round("v", 6).alias("first_value"))


def sql_params(spark, sf):
    load(spark, sf, "orders").createOrReplaceTempView("fitlens_orders")
    named = tables.sql(spark, "SELECT o_orderstatus, count(*) AS n FROM fitlens_orders WHERE o_totalprice > :floor GROUP BY 1", {"floor": 100000.0})
    placed = tables.sql(spark, "SELECT o_orderstatus, max(o_orderkey) AS last_key FROM fitlens_orders WHERE o_orderpriority <> ? GROUP BY 1", ["1-URGENT"])
    return named.join(placed, "o_orderstatus")


def _labelled(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return load(spark, sf, "labels").join(docs, "doc_id")


def label_metrics(spark, sf):
    out = evaluate.label_metrics(_labelled(spark, sf), F.col("quality") == 1, F.col("n_chars") > 600, ["lang"])
    return out.select("lang", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def confusion(spark, sf):
    df = _labelled(spark, sf)
    return evaluate.confusion(df, F.col("quality").cast("int"), (F.col("n_chars") > 600).cast("int"))


def label_model(spark, sf):
    """Quality labels learned from the length of a text and from two words; the labelled documents judged
    at a threshold of the probability."""
    docs = load_wide(spark, sf, "documents", "doc_id", "text")
    low = F.lower("text")
    features = {"length": F.log1p(F.length("text").cast("double")), "first": F.contains(low, F.lit("the")).cast("double"),
                "second": F.contains(low, F.lit("de ")).cast("double")}
    df = load(spark, sf, "labels").join(docs, "doc_id").select("quality", *[c.alias(n) for n, c in features.items()])
    fit = fit_logistic(df, F.col("quality") == 1, {n: F.col(n) for n in features}, ridge=1.0)
    out = evaluate.label_metrics(df, F.col("quality") == 1, fit.probability() >= 0.75)
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                      *[F.round(F.lit(w), 5).alias(f"w_{n}") for n, w in fit.weights.items()])


def _model_check(rounds=12):
    """Newton steps in SQL: a step solves the four equations by elimination, each an expression of sums."""
    x = ["1.0", "a", "b", "c"]
    z = " + ".join(f"w{i} * {v}" for i, v in enumerate(x))
    p = f"(1 / (1 + exp(-({z}))))"
    steps = ["s0 AS (SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3)"]
    for k in range(rounds):
        sums = ", ".join(f"sum({p} * (1 - {p}) * {x[i]} * {x[j]}) + {int(i == j > 0)} AS m{i}{j}" for i in range(4) for j in range(4))
        rest = ", ".join(f"sum((y - {p}) * {x[i]}) - {int(i > 0)} * any_value(w{i}) AS m{i}4" for i in range(4))
        steps.append(f"e{k}_0 AS (SELECT {', '.join(f'any_value(w{i}) AS w{i}' for i in range(4))}, {sums}, {rest} FROM d CROSS JOIN s{k})")
        for at in range(4):
            rows = ", ".join(
                (f"m{at}{j} / m{at}{at} AS m{at}{j}" if i == at else f"m{i}{j} - m{i}{at} * m{at}{j} / m{at}{at} AS m{i}{j}")
                for i in range(4) for j in range(5))
            steps.append(f"e{k}_{at + 1} AS (SELECT w0, w1, w2, w3, {rows} FROM e{k}_{at})")
        steps.append(f"s{k + 1} AS (SELECT {', '.join(f'w{i} + m{i}4 AS w{i}' for i in range(4))} FROM e{k}_4)")
    return f"""WITH d AS MATERIALIZED (SELECT (quality = 1)::INT::DOUBLE AS y, ln(1 + length(text)::DOUBLE) AS a, contains(lower(text), 'the')::INT::DOUBLE AS b,
            contains(lower(text), 'de ')::INT::DOUBLE AS c FROM labels JOIN documents USING (doc_id)), {', '.join(s.replace(' AS (', ' AS MATERIALIZED (', 1) for s in steps)},
        j AS (SELECT y = 1 AS t, {p} >= 0.75 AS p, w0, w1, w2, w3 FROM d CROSS JOIN s{rounds}),
        n AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn,
            any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3 FROM j)
        SELECT tp, fp, fn, tn, {_RATIO.format(a='tp', b='tp + fp')} AS precision, {_RATIO.format(a='tp', b='tp + fn')} AS recall,
            {_RATIO.format(a='2 * tp', b='2 * tp + fp + fn')} AS f1, round(w0, 5) AS w_intercept, round(w1, 5) AS w_length, round(w2, 5) AS w_first, round(w3, 5) AS w_second FROM n"""


_RATIO = "CASE WHEN {b} = 0 THEN 0.0 ELSE round(({a})::DOUBLE / ({b}), 6) END"
_KEYED = """p AS (SELECT event_type AS file, event_id AS pos, value < 2 AS bad, 'u' || user_id AS company, 'T' || user_id % 3 AS job_title, ts::DATE AS date_posted FROM events),
k AS (SELECT DISTINCT company, job_title, date_posted FROM p WHERE file = 'signup'),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, job_title, date_posted ORDER BY file, pos) AS rn FROM p WHERE NOT bad)
      WHERE rn = 1 AND (company, job_title, date_posted) NOT IN (SELECT (company, job_title, date_posted) FROM k))"""

QUERIES = {
    "posting_intake": (posting_intake, """SELECT event_id::VARCHAR AS file,
        CASE event_id % 6 WHEN 3 THEN 'missing_description' WHEN 4 THEN 'not_an_object' WHEN 5 THEN 'invalid_file' END AS reason,
        CASE WHEN event_id % 6 <= 2 THEN event_type ELSE 'Unknown Title' END AS job_title,
        CASE WHEN event_id % 6 <= 2 THEN 'u' || user_id ELSE 'Unknown Company' END AS company,
        CASE WHEN event_id % 6 = 1 THEN 'L' || user_id % 7 END AS location,
        CASE WHEN event_id % 6 <= 2 THEN props END AS job_description,
        CASE WHEN event_id % 6 = 2 THEN (user_id + 1)::VARCHAR END AS salary_range,
        CASE WHEN event_id % 6 <= 2 THEN ts::DATE::VARCHAR ELSE '2026-01-02' END AS date_posted, 'manual' AS source FROM events"""),
    "date_coerce": (date_coerce, "SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (4, 6) THEN '2026-01-02' ELSE o_orderdate::DATE::VARCHAR END AS day FROM orders"),
    "json_extract": (json_extract, """SELECT event_type, '{"sum_k":' || sum((props->>'k')::INT) || ',"n":' || count(*) || '}' AS packed FROM events GROUP BY 1"""),
    "ingest_stats_rollup": (ingest_stats_rollup, f"""WITH {_KEYED}, o AS (SELECT p.file, CASE WHEN bad THEN 'e' WHEN w.pos IS NOT NULL THEN 'i' ELSE 'd' END AS o
            FROM p LEFT JOIN (SELECT file, pos FROM w) w ON w.file = p.file AND w.pos = p.pos)
        SELECT file, grouping(file)::INT AS is_total, count(*) FILTER (o = 'i') AS inserted, count(*) FILTER (o = 'd') AS duplicates,
               count(*) FILTER (o = 'e') AS errors FROM o GROUP BY ROLLUP (file)"""),
    "anti_join_new": (anti_join_new, f"WITH {_KEYED} SELECT file, pos, company, job_title, date_posted::VARCHAR AS date_posted FROM w"),
    "dedup_keep_first": (dedup_keep_first, """SELECT user_id, event_type, event_id, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1"""),
    "dedup_exact_text": (dedup_exact_text, "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"),
    "dedup_ignore_case": (dedup_ignore_case, """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) || ' ' ELSE p_name END AS name, p_brand FROM part)
        SELECT p_partkey, name, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)), lower(trim(p_brand)) ORDER BY p_partkey) AS rn FROM p) WHERE rn = 1"""),
    "left_join_meta": (left_join_meta, """SELECT o_orderkey, o_custkey, o_orderstatus, c_name, c_mktsegment FROM orders
        LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey WHERE o_orderstatus = 'F'"""),
    "inner_lookup": (inner_lookup, "SELECT o_orderkey, c_name, lower(c_mktsegment) || '|any' AS tags FROM orders JOIN customer ON c_custkey = o_custkey"),
    "processed_flag": (processed_flag, """SELECT o_orderkey AS job_id, o_orderstatus,
        o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48) AS is_processed FROM orders"""),
    "status_counts": (status_counts, """SELECT count(*) AS total, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS processed,
        sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END)::BIGINT AS unprocessed FROM orders"""),
    "outcome_counts": (outcome_counts, "SELECT count(*) FILTER (value >= 2) AS processed, count(*) FILTER (value < 2) AS errors FROM events"),
    "unique_violations": (unique_violations, "SELECT l_orderkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "orphan_rows": (orphan_rows, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"),
    "length_violations": (length_violations, """SELECT doc_id, 'text:null' AS reason FROM documents WHERE lang = 'es'
        UNION ALL SELECT doc_id, 'text:longer_than_2000' FROM documents WHERE lang <> 'es' AND length(text) > 2000
        UNION ALL SELECT doc_id, 'source:longer_than_4' FROM documents WHERE length(source) > 4"""),
    "unprocessed_latest": (unprocessed_latest, "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey"),
    "unprocessed_postings": (unprocessed_postings, """SELECT o_orderkey AS job_id, o_orderdate::DATE::VARCHAR AS day FROM orders
        WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) ORDER BY o_orderdate DESC, o_orderkey"""),
    "top_head": (top_head, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5"),
    "first_per_section": (first_per_section, "SELECT label, round(arg_min(embedding[1]::DOUBLE, vec_id), 6) AS first_value FROM embeddings GROUP BY 1"),
    "sql_params": (sql_params, """SELECT a.o_orderstatus, n, last_key FROM (SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1) a
        JOIN (SELECT o_orderstatus, max(o_orderkey) AS last_key FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1) b USING (o_orderstatus)"""),
    "label_metrics": (label_metrics, f"""WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND n_chars > 600) AS tp, count(*) FILTER (quality <> 1 AND n_chars > 600) AS fp,
            count(*) FILTER (quality = 1 AND n_chars <= 600) AS fn, count(*) FILTER (quality <> 1 AND n_chars <= 600) AS tn FROM labels JOIN documents USING (doc_id) GROUP BY 1)
        SELECT lang, tp, fp, fn, tn, {_RATIO.format(a='tp', b='tp + fp')} AS precision, {_RATIO.format(a='tp', b='tp + fn')} AS recall,
               {_RATIO.format(a='2 * tp', b='2 * tp + fp + fn')} AS f1 FROM c"""),
    "label_model": (label_model, _model_check()),
    "confusion": (confusion, "SELECT quality::INT AS truth, (n_chars > 600)::INT AS predicted, count(*) AS n_rows FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2"),
}
