import math
import zlib
from fractions import Fraction
from functools import reduce

import numpy as np

from fitlens.llm import langid
from fitlens.llm.queries import vocabulary

from tests.llm.conftest import DATA

PATH = vocabulary()
PIECES = ["▁", "a", "b", "ab", "▁a", "bb", "▁ab"]


def brute_probability(word, p):
    """Sum over every way to cut the marked word into pieces."""
    text = "▁" + word

    def rest(i):
        if i == len(text):
            return 1.0
        total = sum(p[k] * rest(i + len(x)) for k, x in enumerate(PIECES) if text.startswith(x, i))
        return total + (langid.UNKNOWN * rest(i + 1) if text[i] not in PIECES else 0.0)
    return rest(0)


def test_forward_sums_all_segmentations():
    p = np.random.default_rng(1).dirichlet(np.ones(len(PIECES)), 3)
    words = ["a", "ab", "abba", "bbb", "abzab", "bab", "zz", "ababab"]
    got = langid.word_scores(langid.Lattice(PIECES), p, words)
    want = [[np.log(brute_probability(w, row)) for row in p] for w in words]
    assert np.allclose(got, want)


def test_expected_counts():
    """Pieces expected in a word, from finite differences of its log-probability."""
    p = np.random.default_rng(2).dirichlet(np.ones(len(PIECES)), 1)
    words, times = ["abba", "ab", "bb"], np.array([2.0, 1.0, 3.0])
    got = langid.expected_pieces(langid.Lattice(PIECES), p, words, np.zeros(3, int), times)[0]
    for k in range(len(PIECES)):
        up = p[0].copy()
        up[k] *= 1 + 1e-6
        slope = sum(t * (np.log(brute_probability(w, up)) - np.log(brute_probability(w, p[0]))) for w, t in zip(words, times)) / 1e-6
        assert abs(got[k] - slope) < 1e-3


def log_probability(word, p):
    """The same sum place by place with whole numbers as fractions, which know no range."""
    text, sums = "▁" + word, [Fraction(1)] + [Fraction(0)] * (len(word) + 1)
    for i in range(len(text)):
        for k, x in enumerate(PIECES):
            if text.startswith(x, i):
                sums[i + len(x)] += sums[i] * Fraction(p[k])
        if text[i] not in PIECES:
            sums[i + 1] += sums[i] * Fraction(langid.UNKNOWN)
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


def test_words_of_any_length():
    """Runs far beyond the range of doubles are one lattice: known and unknown letters, short words beside them."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.ones(len(PIECES)), 2)
    words = ["ab", "".join(rng.choice(list("ab"), 400)), "z" * 150, "".join(rng.choice(list("abz"), 300)), "a", "b" * 33]
    lattice = langid.Lattice(PIECES)
    for group in (64_000, 50):
        langid.GROUP = group
        got = langid.word_scores(lattice, p, words)
        assert np.allclose(got, [[log_probability(w, row) for row in p] for w in words], rtol=1e-12)
    langid.GROUP = 64_000
    long = langid.word_scores(lattice, p, ["ab" * 100_000])
    assert np.isfinite(long).all()
    times = np.array([1.0, 2.0, 1.0, 3.0, 1.0, 1.0])
    found = langid.expected_pieces(lattice, p[:1], words, np.zeros(6, int), times)[0]
    for k in range(len(PIECES)):
        up = p[0].copy()
        up[k] *= 1 + 1e-4
        slope = sum(t * (log_probability(w, up) - log_probability(w, p[0])) for w, t in zip(words, times)) / 1e-4
        assert abs(found[k] - slope) < 0.05 + 1e-3 * abs(slope)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in langid.languages(docs, PATH).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= got[r.doc_id].score <= 1
    unseen = [r for r in rows if got[r.doc_id].held_out]
    assert unseen and sum(got[r.doc_id].lang_pred == r.lang for r in unseen) >= 0.95 * len(unseen)
    again = {r.doc_id: r for r in langid.languages(docs.repartition(7), PATH).collect()}
    assert all(again[k].lang_pred == got[k].lang_pred for k in got)


def test_odd_rows(spark, docs_of, odd_texts, empty_docs):
    english = docs_of([(i, "the cat and the house of that man with this thing") for i in range(100, 140)])
    french = docs_of([(i, "le chat et la maison de cette fille avec une chose") for i in range(200, 240)], lang="fr")
    odd = docs_of([*enumerate(odd_texts), (90, "12 345 !?"), (91, "½ ²"), (92, "漢字 и кот"), (None, "the man and the thing"), (93, "A" * 3000)], lang=None)
    df = reduce(lambda a, b: a.unionByName(b), [english, french, odd])
    got = langid.languages(df, PATH).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got}
    assert {by[k].lang_pred for k in (0, 1, 2, 90, 91)} == {"und"} and by[0].score == 0
    assert {by[k].lang_pred for k in range(100, 140)} == {"en"} and {by[k].lang_pred for k in range(200, 240)} == {"fr"}
    assert by[None].lang_pred == "en" and by[None].held_out is False
    assert by[92].lang_pred in ("en", "fr") and by[93].lang_pred in ("en", "fr")
    assert langid.languages(empty_docs, PATH).collect() == []
    assert {r.lang_pred for r in langid.languages(odd, PATH).collect()} == {"und"}
