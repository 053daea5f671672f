import random

import numpy as np

from fitlens.llm import tiling

from tests.llm.conftest import DATA


def greedy(item, text, width):
    """Greedy string tiling by its definition: longest free common run first, first place wins."""
    used_i, used_t, out = set(), set(), []
    while True:
        best = None
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and a + n not in used_i and b + n not in used_t:
                    n += 1
                if n >= width and (best is None or n > best[2]):
                    best = (a, b, n)
        if best is None:
            return out
        a, b, n = best
        used_i |= set(range(a, a + n))
        used_t |= set(range(b, b + n))
        out.append(best)


def test_against_definition():
    rng = random.Random(4)
    for _ in range(150):
        width = rng.choice([2, 3])
        item = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
        text = [rng.choice("abcde") for _ in range(rng.randint(0, 25))]
        found = tiling.Items([(1, " ".join(item))], width).matches(" ".join(text))
        want = greedy(item, text, min(width, len(item)))
        assert sum(m[1] for m in found) == sum(t[2] for t in want)
        assert sum(m[3] for m in found) == len(want)


def test_reordered_passages(docs_of, spark):
    item = [f"w{i}" for i in range(30)]
    parts = [" ".join(item[i:i + 10]) for i in (20, 0, 10)]
    rows = [" filler here ".join(parts).upper(), " ".join(item[:17]), " ".join(item[:18]), None, "", "w1 w0 w3 w2", "...".join(item), " ".join(item)]
    bench = spark.createDataFrame([(7, " ".join(item), "x"), (8, None, "x"), (9, "", "x"), (10, "!?", "x"), (11, "Unused words", "x")], "item_id long, text string, doc_id string")
    df = docs_of(rows)
    for size in (1 << 20, 1):
        got = {(r.doc_id, r.item_id): (r.covered_words, r.n_tiles) for r in tiling.leaked_items(df, bench, block_bytes=size).collect()}
        assert got == {(0, 7): (30, 3), (2, 7): (18, 1), (6, 7): (30, 1), (7, 7): (30, 1)}
        clean = tiling.without_leaks(df, bench, block_bytes=size)
        assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [1, 3, 4, 5]


def test_empty_and_long(docs_of, empty_docs, spark, odd_texts):
    bench = spark.createDataFrame([(1, odd_texts[3][1000:1400])], "item_id long, text string")
    assert [r.doc_id for r in tiling.leaked_items(docs_of(odd_texts), bench).collect()] == [3]
    assert tiling.leaked_items(empty_docs, bench).collect() == []
    assert tiling.leaked_items(docs_of(odd_texts), bench.limit(0)).collect() == []
    assert tiling.without_leaks(docs_of(["a", None]), bench.limit(0)).count() == 2


def test_string_ids(docs_of, spark):
    words = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([("i-1", words), (None, words + " more")], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in tiling.leaked_items(docs_of([words, "w1 w2"]), bench).collect()} == {(0, "i-1"), (0, None)}


def test_planted_leaks(spark):
    """Every document that holds an item's words in one run is found, and none without half of them."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in tiling.leaked_items(docs, bench).collect()}
    items = [(r.item_id, " ".join(tiling.words_of(r.text))) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if f" {t} " in f" {' '.join(tiling.words_of(r.text))} "}
    assert want and want <= found


def test_running_hash():
    ids = np.array([3, 1, 3, 1, 3])
    h = tiling.running_hash(ids, 2)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1] and len(tiling.running_hash(ids, 9)) == 0
