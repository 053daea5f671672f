import math
import re
from collections import Counter

import numpy as np

from fitlens.llm import outliers

from tests.llm.conftest import DATA

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


def statistics(text, c):
    words, upper = max(1, c[0]), sum((text or "").count(x) for x in outliers.UPPER)
    chars = max(1, c[1])
    return [math.log(chars / words), math.log1p(100 * c[2] / words), math.sqrt(upper / chars), c[4] / words]


def distances(rows):
    """Concentration steps in numpy for one group; the first step starts from Spark's medians."""
    base = np.array([x for x, failed in rows if not failed])
    floor = np.array(outliers.FLOORS) ** 2
    centre = np.array([np.sort(base[:, i])[(len(base) - 1) // 2] for i in range(base.shape[1])])
    shape = np.diag(floor)

    def far(x):
        d = x - centre
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(shape), d)
    for _ in range(outliers.STEPS):
        bins = np.floor(np.log1p(far(base)) * outliers.BINS)
        order = np.sort(bins)
        near = base[bins <= order[math.ceil(len(base) * outliers.SUPPORT) - 1]]
        centre = near.mean(0)
        shape = 2 * (near.T @ near / len(near) - np.outer(centre, centre)) + np.diag(floor)
    return far(np.array([x for x, _ in rows]))


def test_counts(docs_of, odd_texts):
    rows = [*enumerate(odd_texts), (70, "a b c a b c a b c"), (71, "x\ny\nx\n \n \nx"), (72, "#*$% &|<> 漢字 é"), (73, "a a a a"), (None, "q")]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in outliers.quality_verdicts(docs_of(rows)).collect()}
    assert got == {k: counts(t) for k, t in rows}


def test_whole_table_against_numpy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in outliers.quality_verdicts(docs).collect()}
    groups = {}
    for r in docs.collect():
        c = counts(r.text)
        assert tuple(got[r.doc_id][k] for k in COLUMNS) == c
        groups.setdefault((r.lang, r.source), []).append((r.doc_id, statistics(r.text, c), c[5]))
    checked = 0
    for rows in groups.values():
        if all(failed for *_, failed in rows):
            assert all(got[k].distance is None and not got[k].kept for k, *_ in rows)
            continue
        for (key, _, failed), far in zip(rows, distances([(x, f) for _, x, f in rows])):
            assert abs(got[key].distance - far) <= 1e-6 * max(1, far)
            assert got[key].kept == (not failed and got[key].distance <= outliers.CUTOFF)
            checked += 1
    assert checked > 100


def test_labels(spark):
    """Labelled good documents that pass the base rules stay; bad ones go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = outliers.quality_verdicts(docs).join(labels, "doc_id").filter("NOT base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert good and bad
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.05 * len(bad)


def test_kept_documents(spark, docs_of, odd_texts, empty_docs):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = outliers.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in outliers.quality_verdicts(docs).collect() if r.kept}
    odd = docs_of(odd_texts, lang=None, source=None)
    assert outliers.kept_documents(odd).columns == odd.columns and outliers.kept_documents(odd).count() > 0
    assert outliers.kept_documents(empty_docs).collect() == [] and outliers.quality_verdicts(empty_docs).collect() == []


def test_native(spark):
    plan = outliers.kept_documents(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
