import csv
import datetime
import glob
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fitlens.functions.sections import ENHANCED, Parser, low_confidence_items
from fitlens.lexicon import SCORE_WEIGHTS, Lexicon
from fitlens.plans import run as flow
from fitlens.plans.embed import posting_sections
from fitlens.sources import exports, postings, profile
from fitlens.sources.tables import Store, spread, sql, with_processed_flag
from fitlens.streaming.intake import start_intake
from tests.test_sections import A, B, C

AS_OF = datetime.date(2026, 1, 2)
PROFILE = {"Name": "not a list", "Summary": [{"Content": "Builds reports."}],
           "TechnicalSkills": [{"Content": "SQL, Python, Tableau"}],
           "Projects": [{"Subsection": "Clinic dashboard", "Bullet": ["Loaded claims", "Drew charts"]},
                        {"Content": "kept only in the overall text", "Subsection": "Other", "Bullet": "no list"}]}


@pytest.fixture
def folder(tmp_path):
    def write(name, data):
        path = tmp_path / "raw" / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(data if isinstance(data, str) else json.dumps(data), encoding="utf-8")
        return str(path.parent)
    return write


def read(spark, path):
    return {(r["file"], r["pos"]): r for r in postings.read_postings(spark, path, "manual", AS_OF).collect()}


def test_aliases_dates_and_rejects(spark, folder):
    d = {"description": "d"}
    folder("a.json", [
        {"title": "A", "company": "", "company_name": "C", **d, "date_posted": 1766188800000},
        {**d, "date_posted": "2025-12-20"},
        {**d, "date_posted": "2025-12-20T23:30:00-07:00"},
        {**d, "posted_date": "2025-12-20T01:00:00Z", "date_posted": 0},
        {**d, "date_posted": "soon"}, {**d, "date_posted": "2025-12"}, d, {**d, "date_posted": 1e30},
        {"title": "no text"}, {"description": "   "}, 7, None, {**d, "salary": 50000, "job_url": [], "link": "u"},
        {**d, "position": 0, "title": False}, {**d, "date_posted": "20251220"}, {**d, "date_posted": "2025-13-40"},
        {**d, "date_posted": [1]}, {**d, "date_posted": 10 ** 18}, {**d, "date_posted": True},
    ])
    folder("b.json", {"position": "P", "job_details": "x", "employment_type": "t", "job_location": "l"})
    folder("bad.json", "{bad")
    folder("num.json", "42")
    folder("tail.json", '[{"description": "x"}] tail')
    folder("empty.json", "[]")
    path = folder("skip.txt", "[]")
    rows = read(spark, path)
    day = datetime.date(2025, 12, 20)
    a = [rows[("a.json", i)] for i in range(19)]
    assert (a[0]["job_title"], a[0]["company"]) == ("A", "C")
    assert [r["date_posted"] for r in a[:4]] == [day] * 4
    assert [r["date_posted"] for r in a[4:7]] == [AS_OF] * 3
    assert [r["reason"] for r in (a[7], *a[16:19])] == ["bad_date", "bad_date", None, None]
    assert a[17]["date_posted"] == AS_OF and a[18]["date_posted"] == datetime.date(1970, 1, 1)
    assert [r["reason"] for r in a[8:12]] == ["missing_description", None, "not_an_object", "not_an_object"]
    assert (a[12]["salary_range"], a[12]["job_url"]) == ("50000", "u")
    assert (a[13]["job_title"], a[13]["company"], a[13]["location"]) == ("Unknown Title", "Unknown Company", None)
    assert a[14]["date_posted"] == day and a[15]["date_posted"] == AS_OF
    b = rows[("b.json", 0)]
    assert (b["job_title"], b["job_type"], b["location"], b["source"]) == ("P", "t", "l", "manual")
    assert {f for (f, _), r in rows.items() if r["reason"] == "invalid_file"} == {"bad.json", "num.json", "tail.json"}
    assert not [f for f, _ in rows if f in ("empty.json", "skip.txt")]


def test_profile_rows(spark, tmp_path):
    (tmp_path / "me.json").write_text(json.dumps(PROFILE))
    df = profile.read_profile(spark, str(tmp_path / "me.json"))
    rows = profile.profile_rows(df).orderBy("ordinal").collect()
    assert [r["content_type"] for r in rows] == [
        "full_resume", "content", "content", "subsection", "bullet", "bullet", "subsection"]
    assert rows[0]["text"] == ("Builds reports. SQL, Python, Tableau Clinic dashboard Loaded claims Drew charts "
                               "kept only in the overall text Other")
    assert rows[3]["text"] == "Clinic dashboard Loaded claims Drew charts"
    assert {r["profile_version"] for r in rows} == {"me"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        profile.read_profile(spark, str(tmp_path / "nobody.json"))


def post(company, text, title="T", day="2025-12-01"):
    return {"company": company, "title": title, "description": text, "date_posted": day}


def test_full_run_is_idempotent(spark, tmp_path, folder):
    folder("one.json", [post("A", A), post("B", "<p>" + B + "</p>"), post("A", "again"), 7])
    raw = folder("two.json", post("C", C))
    folder("broken.json", "{")
    (tmp_path / "me.json").write_text(json.dumps(PROFILE))
    settings = flow.Settings(postings=raw, profile=str(tmp_path / "me.json"), results=str(tmp_path / "out"),
                             as_of=AS_OF, dim=64)
    store = Store(spark, str(tmp_path / "store"))
    stats = {r["file"]: (r["inserted"], r["duplicates"], r["errors"]) for r in flow.intake(store, settings).collect()}
    assert stats == {"one.json": (2, 1, 1), "two.json": (1, 0, 0), "broken.json": (0, 0, 1), None: (3, 1, 2)}
    ranked = flow.run(spark, store.root, settings, skip=("intake",))
    rows = ranked.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3]
    scores = [r["composite_score"] for r in rows]
    assert scores == sorted(scores, reverse=True)
    by = {r["company"]: r for r in rows}
    assert by["A"]["matched_skills"] == ["SQL", "Tableau"]
    assert by["A"]["missing_skills"] == ["Git", "Kafka", "r"] and by["A"]["skill_match_ratio"] == 0.4
    assert len(by["A"]["best_resume_matches"]) == 5
    sections = {(r["company"], r["section"]) for r in
                posting_sections(store.read("clean_postings")).join(store.read("raw_postings"), "job_id").collect()}
    assert ("A", "qualifications") in sections and ("C", "summary") not in sections

    with open(glob.glob(settings.exported["csv"] + "/*.csv")[0]) as f:
        head = next(csv.reader(f))
    assert head == list(exports.SUMMARY_COLUMNS)
    detail = spark.read.json(settings.exported["json"])
    assert detail.count() == 3 and "best_resume_matches" in detail.columns

    counts = {n: store.read(n).count() for n in ("raw_postings", "clean_postings", "job_embeddings", "rankings",
                                                 "granular_scores")}
    assert counts["granular_scores"] > 0
    flow.run(spark, store.root, settings)
    assert {n: store.read(n).count() for n in counts} == counts

    # Declared weights use every component.
    settings.weights = dict(SCORE_WEIGHTS)
    weighted = {r["company"]: r["composite_score"] for r in flow.run(
        spark, store.root, settings, skip=("intake", "preprocess", "vectorize")).collect()}
    assert set(weighted) == {"A", "B", "C"} and weighted != {r["company"]: r["composite_score"] for r in rows}
    assert max(weighted.values()) <= 1.0 and min(weighted.values()) >= 0.0
    settings.weights = {"overall_similarity": 0.5, "charm": 0.5}
    assert "no such score: charm" in flow.check_inputs(store, settings)
    settings.weights = None

    # Cleaning again with other rules replaces only the vectors of changed texts.
    store.clear(["clean_postings"])
    settings.lexicon = Lexicon(qualification_headers=("no such heading",))
    flow.run(spark, store.root, settings, skip=("intake",))
    vectors = {(r["job_id"], r["section"]) for r in store.read("job_embeddings").collect()}
    assert len(vectors) == store.read("job_embeddings").count() < counts["job_embeddings"]
    assert not [s for _, s in vectors if s == "qualifications"]

    other = tmp_path / "other.json"
    other.write_text(json.dumps({"Summary": [{"Content": "calm"}]}))
    settings.profile = str(other)
    flow.run(spark, store.root, settings, skip=("intake", "preprocess"))
    versions = {r["profile_version"]: r["count"] for r in store.read("rankings").groupBy("profile_version").count().collect()}
    assert versions == {"me": 3, "other": 3}

    flagged = with_processed_flag(store.read("raw_postings"), store.read("clean_postings"))
    assert flagged.filter("is_processed").count() == 3
    store.register()
    assert sql(spark, "SELECT * FROM raw_postings WHERE company = :c", {"c": "A"}).count() == 1
    assert sql(spark, "SELECT * FROM raw_postings WHERE company = ?", ["B"]).count() == 1
    assert store.clear()["rankings"] == 6
    assert store.read("rankings").count() == 0 and store.read("raw_postings").count() == 3
    assert {r["table"] for r in store.listing().filter("present").collect()} >= {"raw_postings", "rankings"}


def test_hooks_options_and_encoders(spark, tmp_path, folder):
    text = "Qualifications\n- 3 years of SQL\nPreferred:\n- Kafka\n- builds charts at Acme Group, Inc.\n"
    raw = folder("one.json", [post("A", text), post("B", "Responsibilities\n- You will lead\n"), 7])
    (tmp_path / "me.json").write_text(json.dumps(PROFILE))
    names = spark.createDataFrame([("Acme Group, Inc.", "ORG")], "name string, label string")
    verbs = spark.createDataFrame([("builds", "build"), ("LEAD", "lead")], "form string, lemma string")
    settings = flow.Settings(postings=raw, profile=str(tmp_path / "me.json"), as_of=AS_OF, dim=8, parser=ENHANCED,
                             gazetteer=names, verbs=verbs)
    store = Store(spark, str(tmp_path / "store"))
    flow.run(spark, store.root, settings)
    assert [tuple(r) for r in store.read("rejects").collect()] == [("one.json", 2, "not_an_object")]
    rows = {r["company"]: r for r in store.read("clean_postings").collect()}
    a = rows["A"]
    assert [q["text"] for q in a["qualifications_required"]] == ["3 years of SQL"]
    assert [q["text"] for q in a["qualifications_bonus"]] == ["Kafka", "builds charts at Acme Group, Inc."]
    assert len(a["qualifications_bonus_confidence"]) == 2 and a["qualifications_required_confidence"] == [0.7]
    assert a["entities"] == {"ORG": ["Acme Group, Inc."]} and a["action_verbs"] == ["build"]
    assert rows["B"]["entities"] == {} and rows["B"]["action_verbs"] == ["lead"]
    low = low_confidence_items(store.read("clean_postings")).collect()
    assert {r["text"] for r in low} == {"Kafka", "builds charts at Acme Group, Inc."}

    # Another encoder replaces every vector, those of the stored profile too.
    def load():
        return lambda texts: texts.map(lambda t: [1.0, float(len(t))])

    settings.load_encoder, settings.encoder, settings.dim, settings.profile = load, "length", 2, None
    flow.run(spark, store.root, settings, skip=("intake", "preprocess"))
    for table in ("job_embeddings", "profile_embeddings"):
        assert {(r["encoder"], len(r["embedding"])) for r in store.read(table).collect()} == {("length/2", 2)}
    assert store.read("rankings").count() == 2
    store.replace_versions({"rankings": store.read("rankings").limit(0)}, store.read("profile_embeddings"))
    assert store.read("rankings").count() == 0 and store.read("granular_scores").count() > 0

    def load_tagger():
        return lambda texts: pd.DataFrame({"entities": [{"X": ["y"]} for _ in texts], "action_verbs": [["do"] for _ in texts]})

    store.clear(["clean_postings"])
    flow.preprocess(store, flow.Settings(load_tagger=load_tagger, parser=Parser(subsections=True, min_confidence=0.6)))
    rows = {r["company"]: r for r in store.read("clean_postings").collect()}
    assert rows["A"]["entities"] == {"X": ["y"]} and rows["B"]["action_verbs"] == ["do"]
    kept = [*rows["A"]["qualifications_required"], *rows["A"]["qualifications_bonus"]]
    assert [q["text"] for q in kept] == ["3 years of SQL"] and rows["A"]["qualifications_required_confidence"] is None


def test_check_inputs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "none"))
    assert flow.check_inputs(store, flow.Settings()) == ["no folder of posting files given", "no profile given"]
    assert "weights" in flow.check_inputs(store, flow.Settings(weights={"a": 0.2}), ("intake",))[0]
    with pytest.raises(ValueError):
        flow.run(spark, store.root, flow.Settings())
    with pytest.raises(FileNotFoundError):
        store.read("rankings")


def test_stream_picks_up_only_new_files(spark, tmp_path, folder):
    raw = folder("one.json", [post("A", A), post("A", "again"), post("B", B)])
    settings = flow.Settings(postings=raw, as_of=AS_OF)
    store = Store(spark, str(tmp_path / "store"))
    for expected, name, data in ((2, None, None), (2, None, None), (3, "two.json", [post("B", "known"), post("C", C)])):
        if name:
            folder(name, data)
        start_intake(store, settings, str(tmp_path / "cp")).awaitTermination()
        assert store.read("raw_postings").count() == expected
        assert store.read("clean_postings").count() == expected
    counts = {(r["batch"], r["file"]): (r["inserted"], r["duplicates"]) for r in store.read("intake_counts").collect()}
    assert counts == {(0, "one.json"): (2, 1), (0, None): (2, 1), (1, "two.json"): (1, 1), (1, None): (1, 1)}
    # A lost stream checkpoint replays every file and still adds nothing.
    start_intake(store, settings, str(tmp_path / "cp2")).awaitTermination()
    assert store.read("raw_postings").count() == 3 and store.read("clean_postings").count() == 3


def test_spread_leaves_wide_scans_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert spread(docs).rdd.getNumPartitions() == cores
    wide = spark.range(100, numPartitions=50)
    assert spread(wide) is wide
    large = spark.range(cores * (4 << 20), numPartitions=1)
    assert spread(large) is large


def test_scoring_without_a_full_description(spark):
    from fitlens.plans.score import full_vectors
    emb = spark.createDataFrame([(1, "full_description", [1.0]), (1, "summary", [2.0]), (2, "summary", [3.0])],
                                "job_id long, section string, embedding array<float>")
    rows = {r["job_id"]: r["embedding"] for r in full_vectors(emb).collect()}
    assert rows == {1: [1.0], 2: None}


def test_nested_columns_as_json(spark):
    df = spark.range(1).select(F.array(F.struct(F.lit("a").alias("text"))).alias("q"))
    coded = exports.encode_nested(df, ["q"])
    assert coded.first()["q"] == '[{"text":"a"}]'
    assert exports.decode_nested(coded, {"q": "array<struct<text:string>>"}).first()["q"][0]["text"] == "a"
