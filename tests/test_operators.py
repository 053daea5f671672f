import os
import re
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from fitlens.functions import tags
from fitlens.functions import vectors as v
from fitlens.lexicon import SCORE_WEIGHTS, validate_weights
from fitlens.operators import cells, dedup, evaluate, gazetteer, match, quality, rank, rows, tagging

DATA = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("a,b,expected", [
    ([1.0, 0.0], [-1.0, 0.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([0.3, 0.4], [0.3, 0.4], 1.0),
    ([1.0, 0.0], [1.0, 1.0], 2 ** -0.5)])
def test_cosine(one, a, b, expected):
    assert one(v.cosine, a=a, b=b) == pytest.approx(expected, abs=1e-12)
    assert one(v.cosine, a=b, b=a) == pytest.approx(expected, abs=1e-12)


def brute(jobs, profile, n, per_section=None):
    """Best profile rows per posting by plain loops over numpy vectors."""
    out = {}
    for job, vec in jobs:
        scored = []
        for ordinal, section, other in profile:
            if vec is None:
                continue
            size = np.linalg.norm(vec) * np.linalg.norm(other)
            sim = 0.0 if size == 0 else min(1.0, max(0.0, float(np.dot(vec, other) / size)))
            scored.append((-round(sim, 12), ordinal, section))
        scored.sort()
        if per_section is None:
            out[job] = [o for _, o, _ in scored[:n]]
        else:
            out[job] = [o for s, k in per_section.items() for _, o, sec in
                        [x for x in scored if x[2] == s][:k]]
    return out


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(7)
    jobs = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(200)]
    jobs += [(200, [0.0] * 8), (201, None)]
    sections = ["overall_resume", "Summary", "Projects", "Education"]
    profile = [(i, sections[0] if i == 0 else sections[1 + i % 3], rng.normal(size=8).astype("float32").tolist())
               for i in range(40)]
    profile += [(40, "Projects", profile[5][2]), (41, "Summary", profile[5][2])]
    jdf = spark.createDataFrame(jobs, "job_id long, embedding array<float>").repartition(3)
    pdf = spark.createDataFrame(profile, "ordinal int, section string, embedding array<float>")
    return jobs, profile, jdf, pdf


@pytest.mark.parametrize("bound", [4096, 10])
@pytest.mark.parametrize("per_section", [None, {"Summary": 1, "Projects": 3}])
def test_match_profile(vectors, bound, per_section, monkeypatch):
    jobs, profile, jdf, pdf = vectors
    monkeypatch.setattr(cells, "JOBS_PER_GROUP", 50)
    got = match.match_profile(jdf, pdf, 5, per_section, max_profile_rows=bound)
    rows = {r["job_id"]: r for r in got.collect()}
    assert len(rows) == len(jobs)
    expected = brute(jobs, profile, 5, per_section)
    for job, _ in jobs:
        assert [m["ordinal"] for m in rows[job]["matches"]] == expected[job]
    assert rows[201]["overall_similarity"] == 0.0 and rows[201]["matches"] == []
    first = np.asarray(jobs[0][1]), np.asarray(profile[0][2])
    cos = float(first[0] @ first[1] / np.linalg.norm(first[0]) / np.linalg.norm(first[1]))
    assert rows[0]["overall_similarity"] == pytest.approx(max(0.0, cos), abs=1e-9)


def test_match_is_narrow(spark):
    emb = spark.read.parquet(f"{DATA}/embeddings.parquet").withColumnRenamed("vec_id", "job_id")
    profile = emb.groupBy(F.col("label").alias("ordinal")).agg(F.min_by("embedding", "job_id").alias("embedding"))
    text = plan(match.match_profile(emb, profile.withColumn("section", F.lit("s"))))
    assert "Exchange" not in text and "MapInArrow" in text


@pytest.mark.parametrize("per_section", [None, {"Summary": 1, "Projects": 3}])
def test_match_is_the_same_at_any_bound(spark, vectors, per_section, monkeypatch):
    """Equal and null ids, several overall rows, null vectors and many versions."""
    jobs, profile, _, _ = vectors
    monkeypatch.setattr(cells, "JOBS_PER_GROUP", 7)
    jdf = spark.createDataFrame([(1, jobs[0][1]), (1, jobs[1][1]), (None, jobs[2][1]), (None, None), (3, jobs[3][1])],
                                "job_id long, embedding array<float>")
    rows = [(f"v{v}", i, "overall_resume" if i < 2 else s, None if i == 9 else x) for v in range(4) for i, s, x in profile[v:v + 14]]
    rows += [("empty", 0, "overall_resume", None), ("empty", 1, "Summary", None)]
    pdf = spark.createDataFrame(rows, "profile_version string, ordinal int, section string, embedding array<float>")

    def result(bound, profile_rows):
        got = match.match_profile(jdf, profile_rows, 5, per_section, max_profile_rows=bound).collect()
        return sorted(((r.job_id, r.profile_version, r.overall_similarity, [(m["ordinal"], m["similarity"]) for m in r.matches]) for r in got), key=str)
    want = result(4096, pdf)
    assert len(want) == 5 * 5
    assert result(10, pdf) == result(3, pdf) == want
    nothing = pdf.filter("profile_version = 'empty'")
    assert result(1, nothing) == result(10, nothing)


def clustered(rng, n, dim=16, centres=40):
    middle = rng.normal(size=(centres, dim))
    return (middle[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, dim))).astype("float32")


@pytest.mark.parametrize("per_section", [None, {"a": 2, "b": 4}])
def test_cells_against_brute_force(spark, per_section, monkeypatch):
    """Both sides large: cells are left out, and the rows are those of all comparisons. A third of the
    profile is one vector, some are null or zero, some postings too, and one is opposite to all."""
    monkeypatch.setattr(cells, "JOBS_PER_GROUP", 60)
    rng = np.random.default_rng(3)
    base = clustered(rng, 1200)
    base[rng.random(1200) < 0.33] = base[0]
    profile = [(i, "overall_resume" if i == 7 else "ab"[i % 2], base[i].tolist()) for i in range(1200)]
    profile[20] = (20, "a", [0.0] * 16)
    asked = clustered(np.random.default_rng(3), 1300)[1000:]
    jobs = [(i, v.tolist()) for i, v in enumerate(asked)] + [(900, None), (901, [0.0] * 16), (902, (-base.mean(0)).tolist())]
    jdf = spark.createDataFrame(jobs, "job_id long, embedding array<float>").repartition(5)
    pdf = spark.createDataFrame(profile, "ordinal int, section string, embedding array<float>").repartition(4)
    small = pdf.filter("ordinal < 30").withColumn("profile_version", F.lit("small"))
    both = pdf.withColumn("profile_version", F.lit("large")).unionByName(small)
    report = {}
    got = match.match_profile(jdf, both, 3, per_section, max_profile_rows=64, report=report)
    rows = {(r.profile_version, r.job_id): r for r in got.collect()}
    assert len(rows) == 2 * len(jobs)
    plain = match.match_profile(jdf, both, 3, per_section, max_profile_rows=5000).collect()
    for r in plain:
        assert rows[(r.profile_version, r.job_id)] == r
    expected = brute(jobs, profile, 3, per_section)
    assert all([m["ordinal"] for m in rows[("large", job)]["matches"]] == expected[job] for job, _ in jobs)
    assert report["cells"] > 15 and 0 < report["compared"] < 0.5 * report["of"]


def test_cells_of_sparse_vectors(spark, monkeypatch):
    """Vectors that do not cluster, of counts of few and of many tokens: cells among the first axes leave out
    much, and the rows are those of all comparisons, ties included. Units are cut, and postings dealt in parts."""
    monkeypatch.setattr(cells, "JOBS_PER_GROUP", 40)
    monkeypatch.setattr(cells, "PART_BYTES", 8 * 32 * 150)
    monkeypatch.setattr(cells, "TILE_ROWS", 7)
    rng = np.random.default_rng(11)

    def counts(n, sizes):
        return [np.bincount(rng.integers(0, 32, size), minlength=32).astype("float32").tolist() for size in rng.choice(sizes, n)]
    base = counts(1500, [1, 2, 3, 4, 5, 6, 8, 120, 400])
    profile = [(i, "overall_resume" if i == 7 else "s", v) for i, v in enumerate(base)]
    jobs = list(enumerate(counts(40, [150, 300]) + counts(5, [2]) + [[1.0] + [0.0] * 31]))
    jdf = spark.createDataFrame(jobs, "job_id long, embedding array<float>").repartition(3)
    pdf = spark.createDataFrame(profile, "ordinal int, section string, embedding array<float>").repartition(4)
    report = {}
    rows = {r.job_id: r for r in match.match_profile(jdf, pdf, 3, max_profile_rows=64, report=report).collect()}
    for r in match.match_profile(jdf, pdf, 3, max_profile_rows=5000).collect():
        assert rows[r.job_id] == r
    assert 0 < report["compared"] < 0.7 * report["of"]


def test_cells_hold_vectors_once(spark, monkeypatch):
    """However many blocks the postings come in, rows and postings are not shuffled for their comparison."""
    monkeypatch.setattr(cells, "JOBS_PER_GROUP", 40)
    monkeypatch.setattr(cells, "PART_BYTES", 8 * 16 * 300)
    plans = []

    def kept(df, *args, keep):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, *args)
    for name in ("stored", "appended"):
        if hasattr(cells, name):
            monkeypatch.setattr(cells, name, partial(kept, keep=getattr(cells, name)))
    rng = np.random.default_rng(9)
    base = clustered(rng, 900)
    jobs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(np.random.default_rng(9), 1060)[900:])], "job_id long, embedding array<float>")
    pdf = spark.createDataFrame([(i, "s", v.tolist()) for i, v in enumerate(base)], "ordinal int, section string, embedding array<float>")
    rows = {r.job_id: r for r in match.match_profile(jobs, pdf, 3, max_profile_rows=64).collect()}
    assert all(rows[r.job_id] == r for r in match.match_profile(jobs, pdf, 3, max_profile_rows=5000).collect())
    compared = [re.search(r"(MapInArrow|CoGroupsInArrow)[^\n]*similarity.*", p, re.S) for p in plans]
    compared = [m.group() for m in compared if m]
    assert len(compared) > 2 * 160 / 40 - 1
    assert not any("Exchange" in p for p in compared)


def test_equal_vectors_of_a_batch():
    """Of equal vectors of a group the first stay, as many as are wanted, by ordinal."""
    v = [[1.0, 2.0], [1.0, 2.0], [1.0, 2.0], [3.0, 0.0], [1.0, 2.0], [1.0, 2.0]]
    batch = pa.RecordBatch.from_pydict({"_hash": pa.array([5, 5, 5, 5, 5, 5]), "ordinal": pa.array([4, 1, 2, 0, 3, 9]),
                                        "_row": pa.array([0, 1, 2, 3, 4, 5]), "embedding": pa.array(v, pa.list_(pa.float32()))})
    # All hashes are the same, as if those of different vectors met: no row of another vector may go.
    group = np.array([0, 0, 0, 0, 0, 1])
    kept = cells._firsts(batch, group, np.array([2, 1]))
    assert {1, 2, 3, 5} <= set(kept.tolist())
    apart = batch.set_column(0, "_hash", pa.array([5, 5, 5, 6, 5, 5]))
    assert cells._firsts(apart, group, np.array([2, 1])).tolist() == [1, 2, 3, 5]


def test_rank_of_written_rows(spark):
    """Ranks do not depend on how sorted rows are kept, and their folder goes when asked to."""
    df = spark.range(500).select(F.col("id"), (F.col("id") * 37 % 101).alias("score")).repartition(7)
    folders = []
    got = rank.global_rank(df, [F.desc("score"), "id"], keep=partial(rows.written, folders=folders))
    assert sorted(got.collect()) == sorted(rank.global_rank(df, [F.desc("score"), "id"]).collect())
    folder = folders[0].removeprefix("file:")
    assert os.path.isdir(folder)
    rows.dropped(spark, folders)
    assert not os.path.exists(folder) and folders == []


def test_candidates_hold_the_best():
    """What single precision leaves out is not among the best, ties and many equal values included."""
    rng = np.random.default_rng(2)
    values = np.round(rng.random((50, 400)), 2)
    off = (values + rng.uniform(-1e-5, 1e-5, values.shape)).astype("float32")
    least = np.where(np.arange(50) % 2, 0.98, 0.0)
    job, row = cells._candidates(off, least, 3, 1.1e-5)
    got = set(zip(job.tolist(), row.tolist()))
    third = np.sort(values, axis=1)[:, -3]
    assert {(i, j) for i, j in zip(*np.nonzero((values >= third[:, None]) & (values >= least[:, None])))} <= got
    assert len(got) < values.size / 10


def test_cells_hold_texts_once(spark):
    """Texts are joined to the best rows and never sent to the cells."""
    rng = np.random.default_rng(5)
    pdf = spark.createDataFrame([(i, "s", "text " * 50 + str(i), v.tolist()) for i, v in enumerate(clustered(rng, 300))],
                                "ordinal int, section string, text string, embedding array<float>")
    jdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(rng, 40))], "job_id long, embedding array<float>")
    got = match.match_profile(jdf, pdf, 2, max_profile_rows=20).collect()
    assert all(m["text"].endswith(f" {m['ordinal']}") and m["content_type"] is None for r in got for m in r.matches)


def test_many_versions_in_bounded_batches(spark, vectors, monkeypatch):
    jobs, profile, jdf, _ = vectors
    monkeypatch.setattr(match, "_OUTPUT_BYTES", 50_000)
    text = "t" * 500
    pdf = spark.createDataFrame([(f"v{v:03}", i, s, text, x) for v in range(100) for i, s, x in profile[:6]],
                                "profile_version string, ordinal int, section string, text string, embedding array<float>")
    got = match.match_profile(jdf, pdf, 5)
    assert got.count() == 100 * len(jobs)
    assert got.filter(F.size("matches") == 5).count() == 100 * (len(jobs) - 1)


def test_several_profile_versions(spark, vectors):
    jobs, profile, jdf, pdf = vectors
    both = pdf.withColumn("profile_version", F.lit("a")).union(
        pdf.filter("ordinal < 12").withColumn("profile_version", F.lit("b")))
    rows = match.match_profile(jdf, both, 3).collect()
    assert len(rows) == 2 * len(jobs)
    for version, subset in (("a", profile), ("b", profile[:12])):
        expected = brute(jobs, subset, 3)
        for r in rows:
            if r["profile_version"] == version:
                assert [m["ordinal"] for m in r["matches"]] == expected[r["job_id"]]
    exploded = match.explode_matches(match.match_profile(jdf, both, 3))
    assert exploded.filter("job_id = 0 and profile_version = 'a'").count() == 3


def test_dimension_mismatch_fails(spark, vectors):
    _, _, _, pdf = vectors
    bad = spark.createDataFrame([(1, [1.0, 2.0])], "job_id long, embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        match.match_profile(bad, pdf).collect()


@pytest.mark.parametrize("bound", [100_000, 1])
def test_global_rank_with_a_hot_score(spark, bound, monkeypatch):
    monkeypatch.setattr(rank, "MAX_BROADCAST_ROWS", bound)
    # Two thirds of the rows tie, and one group holds most rows.
    df = spark.range(3000).select(
        F.col("id").alias("job_id"), F.when(F.col("id") % 3 < 2, 0.0).otherwise(F.col("id") / 10).alias("score"),
        F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("v"))
    rows = df.collect()
    got = {r["job_id"]: r["rank"] for r in rank.global_rank(df, [F.desc("score"), "job_id"]).collect()}
    ordered = sorted(rows, key=lambda r: (-r["score"], r["job_id"]))
    assert got == {r["job_id"]: i + 1 for i, r in enumerate(ordered)}
    grouped = rank.global_rank(df, [F.desc("score"), "job_id"], group=["v"]).collect()
    for name in "ab":
        expected = [r["job_id"] for r in ordered if r["v"] == name]
        ranked = sorted((r for r in grouped if r["v"] == name), key=lambda r: r["rank"])
        assert [r["job_id"] for r in ranked] == expected
        assert [r["rank"] for r in ranked] == list(range(1, len(expected) + 1))


def test_keep_first_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([("c", "t", "2025-01-01", "f1", 1), ("c", "t", "2025-01-01", "f0", 7),
                                ("C", "t", "2025-01-01", "f2", 0)],
                               "company string, job_title string, date_posted string, file string, pos int")
    first = dedup.keep_first(df, ["file", "pos"])
    assert sorted((r["company"], r["file"]) for r in first.collect()) == [("C", "f2"), ("c", "f0")]
    assert "WindowGroupLimit" in plan(first)
    assert dedup.keep_first(first, ["file", "pos"]).count() == 2
    loose = dedup.keep_first(df, ["file", "pos"], dedup.folded(["company", "job_title"]) + ["date_posted"])
    assert [r["file"] for r in loose.collect()] == ["f0"]


def test_quality(spark):
    empty = spark.createDataFrame([], "id int, done boolean")
    assert tuple(quality.status_counts(empty, F.col("done")).first()) == (0, None, None)
    bad = spark.createDataFrame([(None, "c", "d", "x" * 1001), ("t", "c", "d", "u")],
                                "job_title string, company string, job_description string, job_url string")
    reasons = [r["reason"] for r in quality.constraint_violations(bad).collect()]
    assert sorted(reasons) == ["job_title:null", "job_url:longer_than_1000"]


def test_weights():
    validate_weights(SCORE_WEIGHTS)
    with pytest.raises(ValueError):
        validate_weights({"a": 0.5, "b": 0.3})


def test_weight_grid_finds_the_right_component(spark):
    df = spark.range(50).select(F.col("id").alias("job_id"), (1 - F.col("id") / 50).alias("good"),
                                F.pmod(F.col("id") * 7, F.lit(50)).cast("double").alias("noise"),
                                (F.col("id") + 1).alias("manual"))
    best = evaluate.weight_grid(df, [{"noise": 1.0}, {"good": 1.0}], "manual").first()
    assert best["point"] == 1 and best["rank_correlation"] == pytest.approx(1.0)


def test_gazetteer_names_of_any_shape(spark):
    """Names of five words, with punctuation, and ones that only look alike."""
    df = spark.createDataFrame([(1, "At Bank of New York Mellon, Paris, she wrote Node.js and C++."), (2, "Plan C, Node js"), (3, None)],
                               "job_id long, text string")
    gaz = spark.createDataFrame([("Bank of New York Mellon", "ORG"), ("Node.js", "PRODUCT"), ("C++", "PRODUCT"), ("Paris", "GPE"), ("!?", "ORG")],
                                "name string, label string")
    got = {r["job_id"]: r["entities"] for r in gazetteer.tag_entities(df, "text", gaz).collect()}
    assert got == {1: {"ORG": ["Bank of New York Mellon"], "PRODUCT": ["C++", "Node.js"], "GPE": ["Paris"]}}
    assert [r["entities"] for r in gazetteer.tag_entities(df, "text", gaz, max_words=1).collect()] == [{"GPE": ["Paris"], "PRODUCT": ["C++"]}]
    assert gazetteer.tag_entities(df, "text", gaz.limit(0)).collect() == []


def plain_entities(text, names, longest):
    """Every name at every word of the text, by plain comparison."""
    token = regex.compile(tags.TOKEN)
    found, hits = list(token.finditer(text or "")), []
    for name, label in names:
        words = token.findall(name)
        for i in range(len(found) - len(words) + 1 if words else 0):
            if [m.group() for m in found[i:i + len(words)]] == words:
                at = found[i].start() - token.search(name).start()
                if name == " ".join(words) or (at >= 0 and text[at:at + len(name)] == name):
                    hits.append((i, len(words), name, label))
    if longest:
        kept, end = [], 0
        for i in range(len(found)):
            here = [h for h in hits if h[0] == i]
            if here and i >= end:
                most = max(h[1] for h in here)
                kept += [h for h in here if h[1] == most]
                end = i + most
        hits = kept
    return {label: sorted({h[2] for h in hits if h[3] == label}) for label in {h[3] for h in hits}}


@pytest.mark.parametrize("longest", [False, True])
@pytest.mark.parametrize("size", [16 << 20, 300])
def test_gazetteer_against_plain_search(spark, monkeypatch, size, longest):
    """One trie, and parts of a table too large for one; a third of the names begin with the same word."""
    monkeypatch.setattr(gazetteer, "TRIE_BYTES", size)
    monkeypatch.setattr(gazetteer, "GROUP", 40)
    rng = np.random.default_rng(9)
    words = ["the", "a", "Node", "js", "of", "New", "York", "x-ray", "it's", "C", "\u00e9t\u00e9"]
    gaps = [" ", " ", " ", ", ", ".", " (", ") ", "-", "\n", "++ "]

    def text(n, lead=""):
        return lead + "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))
    names = {(text(rng.integers(1, 6), "the " if k % 3 == 0 else "").strip(), ["ORG", "GPE"][k % 2]) for k in range(150)}
    names |= {("Node.js", "PRODUCT"), ("C++", "PRODUCT"), (".js", "PRODUCT"), ("!?", "ORG"), ("", "ORG"), ("New York", "ORG"), ("New York", "GPE")}
    texts = [text(rng.integers(0, 60)) for _ in range(60)] + [None, "", "Node.js", "C++", "x.js", "the " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "job_id long, text string").repartition(3)
    gaz = spark.createDataFrame([*names, (None, "ORG"), ("the", None)], "name string, label string")
    got = {r["job_id"]: r["entities"] for r in gazetteer.tag_entities(df, "text", gaz, longest=longest).collect()}
    want = {k: plain_entities(t, sorted(names), longest) for k, t in enumerate(texts)}
    assert got == {k: v for k, v in want.items() if v}


def test_in_plan_names_with_punctuation(spark):
    """The small lexicon in the plan and the table follow one rule."""
    names = {"Node.js": "PRODUCT", "C++": "PRODUCT", "Power BI": "PRODUCT", "Paris": "GPE", "!?": "ORG"}
    df = spark.createDataFrame([(1, "We use Node.js and C++ in Paris, Power BI too"), (2, "Node js and C, Power-BI"), (3, "")], "job_id long, text string")
    table = spark.createDataFrame(list(names.items()), "name string, label string")
    by_table = {r.job_id: r.entities for r in gazetteer.tag_entities(df, "text", table).collect()}
    in_plan = {r.job_id: r.e for r in df.select("job_id", tags.entity_map(tags.tokens("text"), names, "text").alias("e")).collect() if r.e}
    assert by_table == in_plan == {1: {"PRODUCT": ["C++", "Node.js", "Power BI"], "GPE": ["Paris"]}}


def test_gazetteer_table_and_model_hooks(spark):
    df = spark.createDataFrame([(1, "Ann met Power BI at New York"), (2, "nothing here")], "job_id long, text string")
    gaz = spark.createDataFrame([("Ann", "PERSON"), ("Power BI", "PRODUCT"), ("New York", "GPE")],
                                "name string, label string")
    rows = gazetteer.tag_entities(df, "text", gaz).collect()
    assert [(r["job_id"], r["entities"]) for r in rows] == [
        (1, {"PERSON": ["Ann"], "PRODUCT": ["Power BI"], "GPE": ["New York"]})]

    def load():
        return lambda texts: pd.DataFrame({"entities": [{"ORG": [t[:3]]} for t in texts],
                                           "action_verbs": [[t.split()[1]] for t in texts]})
    tagged = {r["job_id"]: r for r in tagging.tag_with(df, "text", load).collect()}
    assert tagged[1]["entities"] == {"ORG": ["Ann"]} and tagged[2]["action_verbs"] == ["here"]

    def load_encoder():
        return lambda texts: texts.map(lambda t: [float(len(t)), 1.0])
    vec = df.select("job_id", v.embed_text_with("text", load_encoder).alias("e")).orderBy("job_id").collect()
    assert vec[1]["e"] == [12.0, 1.0]
    own = df.select(v.embed_text("text", lambda s: s.map(lambda t: [1.0])).alias("e")).collect()
    assert [r["e"] for r in own] == [[1.0], [1.0]]


def test_hashed_embedding(spark):
    df = spark.createDataFrame([("a b A",), ("",), (None,)], "t string")
    rows = [r["e"] for r in df.select(v.embed_text("t", dim=16).alias("e")).collect()]
    assert sum(x * x for x in rows[0]) == pytest.approx(1.0, abs=1e-6)
    assert rows[1] == rows[2] == [0.0] * 16
