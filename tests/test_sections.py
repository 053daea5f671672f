import itertools
import random

import pytest
from pyspark.sql import functions as F

from fitlens.catalog import all_queries
from fitlens.functions import sections as s
from fitlens.functions import tags
from fitlens.lexicon import DEFAULT_LEXICON

A = """Harbor Metrics is growing its reporting group.

Responsibilities:
- Build weekly sales dashboards
- Assist the finance team with audits
- Oversee data quality checks

Requirements:
- Four years with SQL (Tableau preferred)
- Clear written style
and patience
1. Git basics

Nice to have:
- Kafka"""
B = """Who we are: a small clinic network.
What you need
* Python or R
* Calm under pressure and organized
The role
a) Maintain nightly pipelines, day-to-day
b) Review schema changes as needed"""
C = "Short text only."


def parsed(spark, text, **kw):
    df = spark.createDataFrame([(text,)], "body string")
    return s.parse_description(df, "body", **kw).first()


def test_posting_a(spark):
    row = parsed(spark, A)
    assert row["qualifications_required"] == []
    assert [tuple(x) for x in row["qualifications_bonus"]] == [
        ("Four years with SQL (Tableau preferred)", "Hard"),
        ("Clear written style and patience", "Soft"),
        ("Git basics Nice to have:", "Hard"),
        ("Kafka", "Hard"),
    ]
    assert [tuple(x) for x in row["responsibilities"]] == [
        ("Build weekly sales dashboards", "lead", "weekly", "Data Visualization"),
        ("Assist the finance team with audits", "support", "regularly", "General"),
        ("Oversee data quality checks", "manage", "regularly", "Data Governance"),
    ]
    cut = A.index("Requirements:")
    assert row["summary"] == A[:cut] + "\n\n" + A[cut:]
    assert parsed(spark, A, summary_mode="complement")["summary"] == A.split("\n")[0]


def test_posting_b(spark):
    row = parsed(spark, B)
    assert [tuple(x) for x in row["qualifications_required"]] == [
        ("Python or R", "Hard"), ("Calm under pressure and organized", "Soft")]
    assert row["qualifications_bonus"] == []
    assert [tuple(x) for x in row["responsibilities"]] == [
        ("Maintain nightly pipelines, day-to-day", "assist", "daily", "Data Engineering"),
        ("Review schema changes as needed", "assist", "ad-hoc", "Database Management"),
    ]
    assert row["summary"] == "Who we are: a small clinic network."


def test_posting_c(spark):
    row = parsed(spark, C)
    assert row["qualifications_required"] == row["qualifications_bonus"] == row["responsibilities"] == []
    assert row["summary"] == C
    assert parsed(spark, "")["summary"] == ""


def test_section_opens_on_the_first_line(spark):
    row = parsed(spark, "Requirements\n- a\nDuties\n- b\nYou have\n- c")
    assert [x["text"] for x in row["qualifications_required"]] == ["a"]
    assert [x["activity"] for x in row["responsibilities"]] == ["b You have", "c"]
    assert row["summary"] == ""


def test_regex_headers(spark):
    text = "Intro\nWhat you'll bring\n- a\nIn this role\n- b"
    assert parsed(spark, text)["responsibilities"] == []
    row = parsed(spark, text, mode="regex")
    assert [x["text"] for x in row["qualifications_required"]] == ["a"]
    assert [x["activity"] for x in row["responsibilities"]] == ["b"]


@pytest.mark.parametrize("text,expected", [
    ("- a\n\n- b\n  more\n-c\n-\n", ["a", "b more -c -"]),
    ("lead in\n1) x\n2. y\nA. upper", ["x", "y A. upper"]),
    ("• nb space\n * star", ["nb space", "star"]),
    ("- - twice", ["- twice"]),
    ("no bullets", []),
    ("", []),
    ("١. arabic digit", ["arabic digit"]),
])
def test_bullets(one, text, expected):
    assert one(s.bullets, x=text) == expected


def test_wide_bullets(one):
    assert one(lambda x: s.bullets(x, s.WIDE_MARKERS), x="◦ a\nB) b\n▪ c") == ["a", "b", "c"]


def test_many_bullets_stay_linear(one):
    text = "\n".join(f"- item {i}\nrest {i}" for i in range(20000))
    out = one(s.bullets, x=text)
    assert len(out) == 20000 and out[-1] == "item 19999 rest 19999"


def test_subsections(one):
    text = "Qualifications\n* first\nRequired:\n• 3+ years\n\nPreferred skills:\n• Cloud\n  badge\n• Go"
    assert [tuple(x) for x in one(s.subsection_classes, x=text)] == [
        ("first", "required"), ("3+ years", "required"), ("Cloud badge", "bonus"), ("Go", "bonus")]


def test_confidence_and_boilerplate(one):
    assert one(s.confidence, x="3+ years experience with SQL") == 1.0
    assert one(s.confidence, x="Design reports") == 0.1
    assert one(lambda x: s.confidence(x, s.RESPONSIBILITY_SIGNALS), x="You will design") == 0.7
    assert one(s.drop_boilerplate, x="We sell tea. Equal opportunity employer, all welcome") == "We sell tea."


def test_keyword_tags(one):
    assert one(lambda x: tags.keyword_hits(x, tags.DEFAULT_LEXICON.posting_skills), x=A) == [
        "Git", "Kafka", "SQL", "Tableau", "r"]
    assert one(lambda x: tags.keyword_hits(x, tags.DEFAULT_LEXICON.posting_skills), x=B) == ["Python", "ai", "r"]
    assert one(lambda x: tags.keyword_hits(x, ("r", "c++", "sql"), "word"), x="are R, C++ and mysql") == ["C++", "R"]
    assert one(tags.profile_skills, x="SQL, Python, Tableau") == ["python", "sql", "tableau"]
    assert one(tags.profile_skills, x="SQL, Python, Tableau, Power BI") == [
        "python", "sql", "r", "power bi", "tableau"]
    assert one(tags.domain_tags, x="A Bi-weekly ETL report") == [
        "Business Intelligence", "Data Engineering", "Data Visualization"]


def test_entities_and_verbs(spark):
    lex = tags.DEFAULT_LEXICON
    df = spark.createDataFrame([("Builds Power BI and SQL Server reports; led teams at Google in New York",)],
                               "x string").withColumn("w", tags.tokens("x"))
    row = df.select(tags.entity_map("w", lex.entities).alias("e"),
                    tags.action_verbs("w", lex.verbs).alias("v"),
                    tags.extracted_skills("x", tags.entity_map("w", lex.entities)).alias("k")).first()
    assert row["e"] == {"ORG": ["Google"], "PRODUCT": ["Power BI", "SQL Server"], "GPE": ["New York"]}
    assert row["v"] == ["build", "lead", "report"]
    assert row["k"] == ["Power BI", "SQL", "SQL Server", "r"]


def test_skill_overlap(spark):
    df = spark.createDataFrame([(["SQL", "r", "Kafka"], ["sql"]), ([], ["sql"])], "j array<string>, p array<string>")
    m = tags.matched_skills("j", "p")
    rows = df.select(m.alias("m"), tags.missing_skills("j", "p").alias("g"),
                     tags.match_ratio(m, "j").alias("r")).collect()
    assert rows[0]["m"] == ["SQL"] and rows[0]["g"] == ["r", "Kafka"] and abs(rows[0]["r"] - 1 / 3) < 1e-12
    assert rows[1]["m"] == [] and rows[1]["r"] == 0.0


def test_verbs_that_no_list_has(spark):
    """Gerunds and past forms by ordered suffix rules, exceptions first."""
    pairs = {"leveraging": "leverage", "planned": "plan", "applied": "apply", "solving": "solve", "handled": "handle", "producing": "produce",
             "shipping": "ship", "walked": "walk", "automating": "automate", "acquired": "acquire", "executing": "execute", "writing": "write",
             "mentoring": "mentor", "negotiated": "negotiate", "using": "use", "thing": None, "speed": None, "bed": None, "sting": None}
    rows = spark.createDataFrame(list(pairs.items()), "w string, want string").select("w", "want", tags.verb_lemma(F.col("w")).alias("got")).collect()
    assert {r.w: r.got for r in rows} == pairs
    df = spark.createDataFrame([("Leveraging tools, leveraged and Managing; walked nothing",), ("",), (None,)], "x string")
    found = [r[0] for r in df.select(tags.unseen_verbs(tags.tokens("x"), DEFAULT_LEXICON.verbs)).collect()]
    assert found == [["leverage", "walk"], [], None]


@pytest.mark.parametrize("mode", ["phrase", "regex"])
def test_first_tags_are_those_of_all_lines(spark, mode):
    """Headings below the line that opens their section, and lines with both, change nothing."""
    lines = ["you have", "you will", "duties and requirements", "plain", "", "qualifications", "the role", "key responsibilities"]
    rng = random.Random(2)
    texts = [[rng.choice(lines) for _ in range(rng.randint(1, 6))] for _ in range(60)] + [[], None]
    df = spark.createDataFrame([(t,) for t in texts], "lines array<string>")
    rows = df.select(F.transform("lines", lambda x: s.section_tag(x, mode=mode)).alias("tags"),
                     s._first_tags(F.col("lines"), DEFAULT_LEXICON, mode).alias("first")).collect()
    for r in rows:
        if r.tags is None:
            assert r["first"] is None
        else:
            assert r["first"].asDict() == {"n": len(r.tags), **{c: r.tags.index(c) + 1 if c in r.tags else 0 for c in "qr"}}


@pytest.mark.parametrize("default", ["b", "a", "d", "none"])
def test_default_class_is_looked_for_last(spark, default):
    """Same class as trying all in order; without a word of a later class the default's words are not tried."""
    table = {"a": ("aa", "ab"), "b": ("bb",), "c": ("cc", "bc"), "d": ("dd",)}
    texts = [" ".join(t) for n in range(4) for t in itertools.permutations(["aa", "ab", "bb", "cc", "bc", "dd"], n)]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", s._first_class(F.col("t"), table, default).alias("c"))
    for t, c in got.collect():
        assert c == next((name for name, words in table.items() if any(w in (t or "") for w in words)), default)
    if default == "b":
        order = str(s._first_class(F.col("t"), table, default))
        assert order.index("cc") < order.index("bb")


def test_words_are_put_into_a_posting_once(spark):
    """Postings hold the text twice; it is made once."""
    for name in ("section_union", "posting_transform"):
        plan = all_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(", that , ") + plan.count(",  that ,  ") == 1
