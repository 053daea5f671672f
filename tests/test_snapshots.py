import glob
import json

import pytest
from pyspark.sql import functions as F

from fitlens.plans import run as flow
from fitlens.sources import snapshots
from fitlens.sources.snapshots import Change, Layout, Snapshots
from fitlens.sources.tables import Store

LAYOUTS = {"ranks": Layout("id long, v string, n int", "v"), "scores": Layout("id long, v string", "v"),
           "vectors": Layout("id long, s string, x int", "id", bucketed=True)}


@pytest.fixture
def snaps(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "root"), LAYOUTS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def ranks(spark, *values):
    return spark.createDataFrame(list(values), LAYOUTS["ranks"].schema)


def scores(spark, *values):
    return spark.createDataFrame(list(values), LAYOUTS["scores"].schema)


def versions(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def test_two_tables_change_together(spark, snaps, monkeypatch):
    with pytest.raises(FileNotFoundError):
        snaps.read("ranks")
    snaps.commit({"ranks": Change(ranks(spark, (1, "a", 1), (2, "b", 1), (3, None, 1))), "scores": Change(scores(spark, (1, "a"), (2, "b")))})
    before = rows(snaps.read("ranks")), rows(snaps.read("scores"))
    assert before == ([(1, "a", 1), (2, "b", 1), (3, None, 1)], [(1, "a"), (2, "b")])

    # The second table fails after the first was written; then the manifest does.
    fails = scores(spark, (9, "a")).withColumn("id", F.expr("cast(raise_error('lost') as bigint)"))
    with pytest.raises(Exception, match="lost"):
        snaps.commit({"ranks": Change(ranks(spark, (9, "a", 9)), versions(spark, "a")), "scores": Change(fails, versions(spark, "a"))})
    assert (rows(snaps.read("ranks")), rows(snaps.read("scores"))) == before
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, f=spark.createDataFrame, **k: 1 / 0 if a[0] and a[0][0][0] == "manifest" else f(*a, **k))
    with pytest.raises(ZeroDivisionError):
        snaps.commit({"ranks": Change(ranks(spark, (9, "a", 9)), versions(spark, "a"))})
    monkeypatch.undo()
    assert (rows(snaps.read("ranks")), rows(snaps.read("scores"))) == before

    # What a reader has planned stays readable after the change.
    held = snaps.read("ranks")
    snaps.commit({"ranks": Change(ranks(spark, (7, "a", 2)), versions(spark, "a", "b")), "scores": Change(scores(spark, (7, "a")), versions(spark, "a"))})
    assert rows(snaps.read("ranks")) == [(3, None, 1), (7, "a", 2)] and rows(snaps.read("scores")) == [(2, "b"), (7, "a")]
    assert rows(held) == before[0]
    snaps.commit({"ranks": Change(ranks(spark, (8, "c", 2)))})
    snaps.commit({"ranks": Change(parts=versions(spark, None)), "scores": Change(whole=True)})
    assert rows(snaps.read("ranks")) == [(7, "a", 2), (8, "c", 2)] and rows(snaps.read("scores")) == []
    assert snaps.vacuum(1) > 0 and rows(snaps.read("ranks")) == [(7, "a", 2), (8, "c", 2)]


def test_writers_from_one_manifest(spark, snaps, monkeypatch):
    snaps.commit({"ranks": Change(ranks(spark, (1, "a", 1)))})
    late = Snapshots(spark, snaps.root, LAYOUTS)
    monkeypatch.setattr(late, "_manifests", lambda numbers=late._manifests(): numbers)
    snaps.commit({"ranks": Change(ranks(spark, (2, "a", 1)))})
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        late.commit({"ranks": Change(ranks(spark, (3, "a", 1)))})
    assert rows(snaps.read("ranks")) == [(1, "a", 1), (2, "a", 1)]


def files_of(snaps, table):
    return {f: open(f, "rb").read() for f in glob.glob(f"{snaps.root}/{table}/*/*/*.parquet")}


def test_one_change_writes_one_bucket(spark, snaps):
    first = spark.range(400).select("id", F.lit("t").alias("s"), F.lit(0).alias("x"))
    snaps.commit({"vectors": Change(first)})
    assert snaps.manifest().filter("kind = 'table'").first()["buckets"] == snapshots.LEAST_BUCKETS
    before = files_of(snaps, "vectors")
    assert len(before) == snapshots.LEAST_BUCKETS
    changed = spark.createDataFrame([(17, "t", 1)], LAYOUTS["vectors"].schema)
    snaps.upsert("vectors", changed, changed, ["id", "s"])
    after = files_of(snaps, "vectors")
    assert {f: after[f] for f in before} == before and len(after) == len(before) + 1
    assert rows(snaps.read("vectors")) == sorted([(k, "t", int(k == 17)) for k in range(400)], key=str)
    touched = snaps.parts_of("vectors", changed)
    assert snaps.read("vectors", touched).filter("id = 17").count() == 1 and snaps.read("vectors", touched).count() < 100
    plan = snaps.read("vectors", touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part#" in plan.split("PartitionFilters")[1][:200]

    # Rows that take nothing out are added; many folders of a part become one.
    for k in range(3):
        snaps.upsert("vectors", spark.createDataFrame([(1000 + k, "t", 2)], LAYOUTS["vectors"].schema), changed.limit(0), ["id", "s"])
    want = rows(snaps.read("vectors"))
    assert len(want) == 403 and len(files_of(snaps, "vectors")) == len(after) + 3
    snaps.compact("vectors", 1)
    folders = snaps.manifest().filter("kind = 'part'").groupBy("part").count()
    assert rows(snaps.read("vectors")) == want and folders.agg(F.max("count")).first()[0] == 1
    snaps.rebucket("vectors", 32)
    assert rows(snaps.read("vectors")) == want and snaps.manifest().filter("kind = 'part'").count() > 20
    snaps.upsert("vectors", changed.limit(0), changed, ["id", "s"])
    assert rows(snaps.read("vectors")) == [r for r in want if r[0] != 17]


def test_one_changed_text_writes_one_bucket_of_vectors(spark, tmp_path):
    """The flow: of many postings one is cleaned anew with another text."""
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.json").write_text(json.dumps([{"company": f"C{k}", "title": "T", "description": f"text number {k}"} for k in range(60)]))
    (tmp_path / "me.json").write_text(json.dumps({"Summary": [{"Content": "text"}]}))
    settings = flow.Settings(postings=str(raw), profile=str(tmp_path / "me.json"), dim=4)
    store = Store(spark, str(tmp_path / "store"))
    flow.run(spark, store.root, settings)
    before = files_of(store.snapshots, "job_embeddings")
    clean = store.read("clean_postings").withColumn(
        "description_clean", F.when(F.col("company") == "C7", "changed").otherwise(F.col("description_clean"))).checkpoint()
    store.write("clean_postings", clean)
    flow.vectorize(store, settings)
    after = files_of(store.snapshots, "job_embeddings")
    assert {f: after[f] for f in before} == before and len(set(after) - set(before)) == 1
    texts = [r.text for r in store.read("job_embeddings").filter("section = 'full_description'").collect()]
    assert len(texts) == 60 and "changed" in texts and "text number 7" not in texts

    # Nothing new: no bucket is written.
    flow.vectorize(store, settings)
    assert files_of(store.snapshots, "job_embeddings") == after
    assert rows(store.read("rankings").select("profile_version").distinct()) == [("me",)]
