import random

import pytest
import sentencepiece

from fitlens.llm import tokens
from fitlens.llm.queries import vocabulary

from tests.llm.conftest import DATA

PATH = vocabulary()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def merges():
    return tokens.read_merges(PATH)


def test_random_texts(library, merges):
    rng = random.Random(1)
    alphabets = (" abcdetheinr▁  éß漢😀\n\t0123=-_.aaa", "the intoan", " =", "<s>/unk ")
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in alphabets for _ in range(2500)]
    texts += [" " * n + x for n in range(70) for x in ("", "a", "the ", " \n")] + ["=" * n for n in range(150)]
    texts += [" " * 5000, "ab" * 5000, "<s>x</s><unk>", "▁", "\x00", "é" * 300]
    assert tokens.counter(merges)(texts) == [len(t) for t in library.encode(texts)]


def test_queue_agrees_with_arrays(merges, monkeypatch):
    words = ["▁" + w for w in ("internationalization", "aaaaaaaa", "x" * 90, "▁▁▁▁▁the", "=====")]
    whole = merges.count(words).tolist()
    monkeypatch.setattr(tokens, "MAX_ROUNDS", 1)
    assert merges.count(words).tolist() == whole


def test_cache_limit(merges, monkeypatch, library):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 3)
    texts = ["one two three four five six", "two seven", "", "eight nine ten one"] * 300
    assert tokens.counter(merges)(texts) == [len(t) for t in library.encode(texts)]


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in tokens.token_counts(docs, PATH).collect()}
    for r in docs.collect():
        n = len(library.encode(r.text))
        assert got[r.doc_id] == (len(r.text.encode()), n, n > 4096)


def test_odd_rows(docs_of, odd_texts, library, empty_docs):
    rows = list(enumerate(odd_texts)) + [(None, "a b"), (4, "one")]
    got = sorted((tuple(r) for r in tokens.token_counts(docs_of(rows), PATH, limit=10).collect()), key=str)
    want = []
    for key, text in rows:
        n = len(library.encode(text or ""))
        want.append((key, len((text or "").encode()), n, n > 10))
    assert got == sorted(want, key=str)
    assert tokens.token_counts(empty_docs, PATH).collect() == []
