import random

import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, removed string, spans string, key string"


@pytest.fixture
def docs_of(spark):
    """Documents from texts or (id, text) pairs, with extra columns whose names the operators use."""
    def make(rows, lang="en", source="s"):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, lang, source, len(t or ""), 1, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)
    return make


@pytest.fixture
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def odd_texts():
    """Null, empty, blank, very long, repeated and tied texts."""
    rng = random.Random(7)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(60_000))
    words = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    return [None, "", " \t\n", long, "one", "one", "One", "x" * 5000, *words, words[0], words[0] + " tail"]
