import random

import numpy as np
import pytest

from fitlens.llm import overlap
from fitlens.llm.queries import op13_count_rtree_join

from tests.llm.conftest import DATA


def shingle_set(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width=3, percent=90):
    """``(id, size, smallest id of the component)`` by all pairs, but for sizes that rule a pair out."""
    sets, parent = [shingle_set(t, width) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((k, len(s), least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def rows_of(got):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str)


def many_texts(seed):
    """Pairs on both sides of 0.9 of all sizes, chains, a crowd around one text, shared passages."""
    rng, texts = random.Random(seed), []
    for _ in range(70):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([2, 3, 5, 11, 14, 30, 120, 700]))]
        texts += [" ".join(base), edited(rng, base, max(1, round(len(base) * rng.uniform(0.002, 0.03))))]
    for n in (11, 12, 13, 21, 22, 40):
        base = [f"s{n}x{i}" for i in range(n)]
        texts += [" ".join(base), " ".join(base[:-1]), " ".join([*base, "more"]), " ".join(["x", *base[1:]])]
    base = [f"c{i}" for i in range(260)]
    texts += [edited(rng, base, rng.randrange(1, 8)) for _ in range(80)]
    chain = [f"k{i}" for i in range(200)]
    for i in range(8):
        chain = chain[3:] + [f"z{i}a", f"z{i}b", f"z{i}c"]
        texts.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(60))
    return texts + [f"{passage} own{i} text{i} here{i}" for i in range(30)] + [f"some{i} words{i} {passage} t{i}" * 2 for i in range(10)]


@pytest.mark.parametrize("part, leaf", [(1 << 21, 32), (3000, 2)])
def test_against_all_pairs(docs_of, odd_texts, monkeypatch, part, leaf):
    """Whole buckets, and buckets dealt out over parts with deep trees."""
    monkeypatch.setattr(overlap, "PART_SHINGLES", part)
    monkeypatch.setattr(overlap, "LEAF", leaf)
    rows = [(2000 - i, t) for i, t in enumerate([*odd_texts, *many_texts(part)])]
    got = overlap.similar_sets(docs_of(rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert rows_of(got) == brute(rows)


@pytest.mark.parametrize("width, percent", [(5, 80), (1, 50), (2, 100)])
def test_other_parameters(docs_of, width, percent):
    rows = list(enumerate(many_texts(width)))
    assert rows_of(overlap.similar_sets(docs_of(rows), width, percent)) == brute(rows, width, percent)


def test_crowd_that_does_not_link(docs_of, monkeypatch):
    """Near copies a little below the threshold of each other, some pairs above: only the rounds after the leaders find these."""
    monkeypatch.setattr(overlap, "PART_SHINGLES", 2000)
    monkeypatch.setattr(overlap, "FIRST_PAIRS", 3)
    rng, base = random.Random(4), [f"b{i}" for i in range(300)]
    rows = list(enumerate(edited(rng, base, rng.choice([3, 6, 8, 9])) for _ in range(150)))
    want = brute(rows)
    assert len({c for *_, c in want}) > 20 and len({c for *_, c in want}) < 140
    assert rows_of(overlap.similar_sets(docs_of(rows))) == want


def test_bound_and_groups():
    """Equal groups exist for every similar pair; the tree finds all points that the bound leaves."""
    rng = np.random.default_rng(1)
    for n in (1, 5, 9, 10, 19, 57, 400, 3000):
        for _ in range(6):
            a = np.unique(rng.integers(0, 2 ** 64, n, np.uint64))
            differ = (len(a) * 2 * 10 // 190) // 2
            b = np.unique(np.concatenate((a[differ:], rng.integers(0, 2 ** 64, differ, np.uint64))))
            if 100 * len(np.intersect1d(a, b)) < 90 * len(np.union1d(a, b)):
                continue
            bands = set(overlap.bands_of(len(a), 90)) & set(overlap.bands_of(len(b), 90))
            assert any(np.intersect1d(overlap.place(a, x, 90)[1], overlap.place(b, x, 90)[1]).size for x in bands)
    counts = rng.poisson(3, (900, 20))
    sizes = counts.sum(1)
    tree = overlap.RTree(counts, sizes)
    for i in range(0, 900, 30):
        want = np.flatnonzero(np.minimum(counts, counts[i]).sum(1) * 170 >= 70 * (sizes + sizes[i]))
        assert np.sort(tree.search(counts[i], sizes[i], 70)).tolist() == want.tolist()


def test_empty_groups_have_keys():
    """A set that fills few groups meets another at empty ones as well."""
    band = overlap.bands_of(100, 90)[0]
    n, spare = overlap.groups_of(band, 90)
    crowded = np.arange(100, dtype=np.uint64)
    assert len(overlap.place(crowded, band, 90)[1]) == n
    spread = np.arange(100, dtype=np.uint64) * np.uint64(2 ** 64 // 100)
    assert len(overlap.place(spread, band, 90)[1]) >= n - spare


def test_null_ids_and_empty(docs_of, empty_docs):
    rows = [(5, "a b c d"), (2, "A b c d"), (2, "a B c d"), (None, "a b c d"), (9, "only nameless"), (None, "two words"), (None, "Two words"), (4, None), (4, ""), (None, " ")]
    assert rows_of(overlap.similar_sets(docs_of(rows))) == brute(rows)
    assert overlap.similar_sets(empty_docs).collect() == []
    assert rows_of(overlap.similar_sets(docs_of([(1, None), (2, " ")]))) == [(1, 0, 1), (2, 0, 2)]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert rows_of(op13_count_rtree_join(spark, DATA)) == brute([(r.doc_id, r.text) for r in docs.collect()])
