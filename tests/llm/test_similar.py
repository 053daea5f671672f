import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fitlens.llm import similar
from fitlens.llm.simhash import keep_rows


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Ids that stay: the least of each component of pairs with Jaccard 0.8 or more."""
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(key, least.get(find(i), key))
    return sorted(least.values())


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("crowd", [2, 64])
def test_stage_against_all_pairs(docs_of, odd_texts, spark, monkeypatch, crowd):
    """Pairs on both sides of 0.8, long and short, chains, and a crowd around one text."""
    monkeypatch.setattr(similar, "CROWD", crowd)
    rng, texts = random.Random(3), list(odd_texts)
    for k in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 9, 30, 120, 600]))]
        texts += [" ".join(base), edited(rng, base, max(1, round(len(base) * rng.uniform(0.01, 0.035))))]
    base = [f"c{i}" for i in range(300)]
    texts += [edited(rng, base, rng.randrange(1, 9)) for _ in range(90)]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    docs = docs_of(rows)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute(rows)


def test_pair_near_the_bound_with_many_bits(docs_of, spark):
    """Three changed words of 130 are 15 shingles: 0.79 to 0.8 and up; four-bit fingerprints miss these."""
    rng, rows = random.Random(11), []
    for k in range(40):
        base = [f"d{k}w{i}" for i in range(140)]
        other = list(base)
        for place in (20, 60, 100):
            other[place] = "changed"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    assert brute(rows) == [2 * k for k in range(40)]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect()) == brute(rows)


def test_null_ids_and_empty(docs_of, empty_docs):
    rows = [(5, "a b c d e"), (2, "A b c d e"), (2, "A b c d e"), (None, "a b c d e"), (9, "something else"), (None, None), (7, "")]
    assert sorted((r.doc_id, r.text) for r in similar.one_of_similar(docs_of(rows)).collect()) == [
        (2, "A b c d e"), (7, ""), (9, "something else")]
    assert similar.one_of_similar(empty_docs).collect() == []


def test_fingerprints_are_searched_by_vantage_points(docs_of, spark, monkeypatch):
    """Near copies link by the vantage-point search, others by shingles only; both end as brute force says."""
    asked, links = [], []
    search, compare = similar.close_links, similar._similar

    def spied(fps):
        asked.append(fps.count())
        return search(fps)

    def compared(pairs, each, docs):
        links.append(compare(pairs, each, docs))
        return links[-1]
    monkeypatch.setattr(similar, "close_links", spied)
    monkeypatch.setattr(similar, "_similar", compared)
    rng, rows = random.Random(5), []
    for k in range(30):
        base = [f"v{k}w{i}" for i in range(400)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, edited(rng, base, 1))]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect()) == brute(rows) == list(range(0, 60, 2))
    assert len(asked) == 1 and asked[0] > 30
    assert links[0].count() > 10 and links[0].count() + links[1].count() == 30


def asked_pairs(monkeypatch):
    """Numbers of different pairs that are compared whole, in a list that fills as they are."""
    asked, compare = [], similar._similar
    monkeypatch.setattr(similar, "_similar", lambda pairs, each, docs: asked.append(pairs.distinct().count()) or compare(pairs, each, docs))
    return asked


def test_crowd_that_is_not_similar_is_not_compared_whole(docs_of, spark, monkeypatch):
    """Texts with three quarters in common share frequent shingles and are close in bits; few of their pairs are compared."""
    monkeypatch.setattr(similar, "CROWD", 8)
    rng, base = random.Random(17), [f"h{i}" for i in range(260)]
    rows = [(k, edited(rng, base, rng.randrange(4, 6))) for k in range(120)]
    rows += [(200 + k, text + " tail") for k, text in rows[:9]]
    asked = asked_pairs(monkeypatch)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect()) == brute(rows)
    sets = [shingle_set(t) for _, t in rows]
    similar_pairs = sum(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert sum(asked) <= 2 * similar_pairs + 100


def test_fingerprints_decide_nothing(docs_of, spark, monkeypatch):
    """Similar texts link however far apart their fingerprints are."""
    described = similar._described
    monkeypatch.setattr(similar, "_described", lambda docs: described(docs).withColumn("fp", F.xxhash64("sid")))
    rng, rows = random.Random(23), []
    for k in range(30):
        base = [f"f{k}w{i}" for i in range(200)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, edited(rng, base, 2))]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect()) == brute(rows) == list(range(0, 60, 2))


def test_parities_differ_in_no_more_than_the_sets():
    rng = random.Random(29)
    for n in (0, 1, 40, 900, 5000):
        words = [f"p{rng.randrange(3000)}" for _ in range(n)]
        a, b = similar.shingles(" ".join(words)), similar.shingles(edited(rng, words, n // 90) if n else "")
        bits = sum(int(x).bit_count() for x in (similar.parities_of(a) ^ similar.parities_of(b)).view("u8"))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))
        assert len(similar.parities_of(a)) == similar.PARITIES


def test_driver_gets_a_byte_a_cell(docs_of, monkeypatch):
    """Steps of the counts follow the counts themselves, and a cell costs the driver one byte."""
    monkeypatch.setattr(similar, "CELLS", 14)
    got, frame = [], type(docs_of(["a"]))
    monkeypatch.setattr(frame, "toArrow", lambda self, read=frame.toArrow: got.append(read(self)) or got[-1])
    rng = random.Random(31)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(2000)) for _ in range(40)]
    steps = similar._common(docs_of([*texts, None, ""]))
    counts = [0] * (1 << similar.CELLS)
    for text in texts:
        for x in similar.shingles(text).tolist():
            counts[x >> 64 - similar.CELLS] += 1
    assert [*steps.nonzero()[0]] == [k for k, n in enumerate(counts) if n > 1]
    order = sorted((n, int(steps[k])) for k, n in enumerate(counts) if n)
    assert [step for _, step in order] == sorted(step for _, step in order) and len({*order}) > 5
    assert sum(x.nbytes for x in got) <= 1.1 * len(steps)


def exchanged(df):
    """Columns that shuffles of the plan are dealt by."""
    return re.findall(r"Exchange hashpartitioning\(([^,]*)", df._jdf.queryExecution().executedPlan().toString())


def test_texts_stay_where_they_lie(docs_of, spark, monkeypatch):
    """Pairs are compared without a shuffle of all texts: only sets of marked documents leave their task."""
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "x y z u v w"), (3, "x y z u v w"), (None, "p q r s t u"), (None, "p q r s t u")]
    docs = docs_of(rows)
    sent = []
    monkeypatch.setattr(similar, "written", lambda df, write=similar.written: sent.append(df) or write(df))
    each = similar.written(similar._described(docs))
    sids = sorted({r.sid for r in each.collect()})
    pairs = spark.createDataFrame([(a, b) for a in sids for b in sids if a < b], "a long, b long")
    assert similar._similar(pairs, each, docs).collect() == []
    (sets,) = [df for df in sent if df.columns == ["sid", "own"]]
    assert exchanged(sets)
    assert all("_key" not in by for by in exchanged(sets))
    assert sorted(r.sid for r in sets.collect()) == sids

    monkeypatch.setattr(similar, "written", lambda df: df)
    kept = keep_rows(docs, each.groupBy("sid").agg(F.min(F.struct("doc_id", "_key")).alias("first")))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "p q r s t u"), (1, "a b c d e f"), (3, "x y z u v w")]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(" not in plan and "_own" in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = keep_rows(docs, each.groupBy("sid").agg(F.min(F.struct("doc_id", "_key")).alias("first")))
        assert sum(by.startswith(("_own", "_hash")) for by in exchanged(kept)) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
