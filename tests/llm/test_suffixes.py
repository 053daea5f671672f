import hashlib
import random

import pytest

from fitlens.llm import suffixes
from fitlens.llm.queries import QUERIES

from tests.llm.conftest import DATA


def brute(rows, length, keep_first):
    places, out = {}, {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        for s in range(len(data) - length + 1):
            places.setdefault(data[s:s + length], []).append((key, s))
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            at = places[data[s:s + length]]
            if (keep_first and at[0] != (key, s)) or (not keep_first and len(at) > 1):
                gone[s:s + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(data), sum(gone), spans, bytes(x for x, g in zip(data, gone) if not g))
    return out


def made(seed):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(10, 120))) for _ in range(12)]
    rows = []
    for i in range(100):
        text = ""
        for _ in range(rng.randint(0, 5)):
            base = rng.choice(bases)
            at = rng.randrange(len(base))
            text += base[at:at + rng.randint(5, 80)] if rng.random() < 0.7 else "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 50)))
        rows.append((i, text if i % 31 else None))
    return rows + [(200, "aab" * 60), (201, "a" * 90), (202, "a" * 21), (203, rows[3][1]), (204, rows[4][1]), (None, rows[5][1])]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("most, chunk", [(50_000, 1 << 20), (1, 40)])
def test_against_all_windows(docs_of, monkeypatch, keep_first, most, chunk):
    monkeypatch.setattr(suffixes, "MAX_STRETCHES", most)
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rows = made(5)
    got = suffixes.without_repeats(docs_of(rows), 24, keep_first, 6).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == brute(rows, 24, keep_first)


def test_longest_previous_factors():
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 30)))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        share = lambda a, b: next((k for k in range(len(text) - max(a, b)) if text[a + k] != text[b + k]), len(text) - max(a, b))
        common = [0] + [share(a, b) for a, b in zip(order, order[1:])]
        got = dict(zip(order, suffixes.longest_previous(order, common)))
        assert got == {i: max([share(i, j) for j in range(i)], default=0) for i in range(len(text))}


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op8_longest_previous_factors"][0](spark, DATA).collect()}
    assert got == {k: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for k, (n, gone, spans, kept) in brute(rows, 400, False).items()}


def test_odd_rows(docs_of, odd_texts, empty_docs):
    rows = [*enumerate(odd_texts)]
    got = suffixes.without_repeats(docs_of(rows), keep_first=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == brute(rows, 400, False)
    text = "z" * 10 + odd_texts[3][:900]
    twice = suffixes.without_repeats(docs_of([(1, text), (1, text)]), keep_first=False).collect()
    assert [(r.doc_id, r.n_removed) for r in twice] == [(1, 910), (1, 910)]
    assert suffixes.without_repeats(empty_docs).collect() == []
