"""Every named query against the SQL that states the same result."""

import decimal

import duckdb
import pytest

import __spark_entry__ as driver
from fitlens.catalog import all_checks, all_queries

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
QUERIES, CHECKS = all_queries(), all_checks()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def rows_of(rows):
    def plain(value):
        return repr(float(value)) if isinstance(value, (float, decimal.Decimal)) else str(value)
    return sorted(tuple(plain(v) for v in row) for row in rows)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
    assert set(QUERIES) <= set(driver.queries()) and set(CHECKS) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = rows_of(df.select(*columns).collect())
    result = duck.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == rows_of([[row[i] for i in order] for row in result.fetchall()])
    assert got


def test_entry(spark):
    df = driver.entry(spark)
    assert "rank" in df.columns and df.count() == 200


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """Native steps stay in the JVM, parsing and matching stay narrow, scans are pruned."""
    for name in ("posting_transform", "section_split", "keyword_skills", "posting_intake", "html_clean"):
        plan = plan_of(QUERIES[name](spark, DATA))
        assert "Python" not in plan
        assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") <= 1
    plan = plan_of(QUERIES["topk_matches"](spark, DATA))
    assert plan.count("ArrowEvalPython") == 1 and plan.count("MapInArrow") == 1
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") <= 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "WindowGroupLimit" in plan_of(QUERIES["dedup_keep_first"](spark, DATA))
    assert "TakeOrderedAndProject" in plan_of(QUERIES["top_head"](spark, DATA))
    for name in QUERIES:
        assert "CartesianProduct" not in plan_of(QUERIES[name](spark, DATA)), name


def test_weighted_composite_parses_and_embeds_once(spark):
    """The parse and the vectors are read by several branches, which must not compute them again."""
    plan = plan_of(QUERIES["weighted_composite"](spark, DATA))
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan
