import re

import numpy as np
import pytest
import xxhash

from fitlens.llm import graph, simhash

from tests.llm.conftest import DATA


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, bits=4):
    fps = {t: fingerprint(t) for _, t in rows}
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[rows[i][1]] ^ fps[rows[j][1]]).bit_count() <= bits:
                parent[find(i)] = find(j)
    names = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            names[find(i)] = min(key, names.get(find(i), key))
    return sorted(((k, f"{fps[t]:016x}", names.get(find(i))) for i, (k, t) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_against_all_pairs(docs_of, odd_texts, monkeypatch):
    monkeypatch.setattr(simhash, "PER_SHARD", 4)
    monkeypatch.setattr(simhash, "PART_ROWS", 3)
    rows = list(enumerate(odd_texts)) + [(None, "one"), (None, "quite alone here"), (3, "one")]
    assert got(simhash.near_duplicates(docs_of(rows))) == brute(rows)


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 6])
def test_links_in_shards(spark, monkeypatch, bits):
    """Components of planted chains and crowds of close fingerprints are those of all pairs."""
    monkeypatch.setattr(simhash, "PER_SHARD", 8)
    monkeypatch.setattr(simhash, "PART_ROWS", 20)
    rng = np.random.default_rng(bits)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 150, dtype=np.uint64)]
    for k in range(150):
        x = fps[k % 30]
        for b in rng.integers(0, 64, int(rng.integers(1, 4))):
            x ^= 1 << int(b)
        fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    forest = simhash.Forest(len(fps))
    edges = simhash.close_links(df, bits).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    forest.join(np.array([at[e.a] for e in edges], int), np.array([at[e.b] for e in edges], int))
    whole = simhash.Forest(len(fps))
    whole.join(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits))
    assert (forest.root == whole.root).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 300)] + [(500, i) for i in range(501, 560)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = {r.node: r.root for r in graph.components(df).collect()}
    assert root == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100, **{i: 500 for i in range(500, 560)}}


def test_one_of_each(docs_of, spark):
    rows = [(5, "a b c d e"), (2, "A b c d e"), (2, "A b c d e"), (None, "a b c d e"), (9, "something else entirely here"), (None, None), (7, "")]
    df = docs_of(rows)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "A b c d e"), (7, ""), (9, "something else entirely here")]


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert got(simhash.near_duplicates(spark.read.parquet(f"{DATA}/documents.parquet"))) == brute(rows)


def test_empty(empty_docs):
    assert simhash.near_duplicates(empty_docs).collect() == []
    assert simhash.one_of_each(empty_docs).collect() == []
