import random

import numpy as np
import pytest

from fitlens.llm import lines


def distance(a, b, most=10 ** 9):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, most):
    text = list(text)
    for _ in range(rng.randint(0, most)):
        at, kind = rng.randrange(len(text) + 1), rng.random()
        if kind < 0.33:
            text.insert(at, rng.choice("abc"))
        elif text and kind < 0.66:
            text.pop(min(at, len(text) - 1))
        elif text:
            text[min(at, len(text) - 1)] = rng.choice("abc")
    return "".join(text)


def brute(rows, threshold, min_chars):
    """Removed line numbers by document, from all pairs of distinct lines."""
    first, out = {}, {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for k, line in enumerate(text.split("\n") if text else []):
            if line.strip(" \t\n\v\f\r"):
                first.setdefault(line, (key is None, key, k))
    late = {a for a in first for b in first if first[b] < first[a] and min(len(a), len(b)) >= min_chars and distance(a, b, threshold) <= threshold}
    for key, text in rows:
        out[key] = [k for k, line in enumerate(text.split("\n") if text else []) if line.strip(" \t\n\v\f\r")
                    and (line in late or first[line] != (key is None, key, k))]
    return out


def made(seed, n=80):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 60))) for _ in range(25)]
    return [(i, None if i % 17 == 0 else "\n".join(
        changed(rng, rng.choice(base), 4) if rng.random() < 0.8 else rng.choice(["", "  ", "Short.", "é漢字 😀"]) for _ in range(rng.randint(0, 6)))) for i in range(n)]


def test_banded_distance():
    rng = random.Random(3)
    for limit in (0, 1, 2, 3, 5):
        for _ in range(1500):
            a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
            b = changed(rng, a, 5)
            assert lines.within(a, b, limit) == min(distance(a, b), limit + 1)


def test_segments_meet():
    """Every pair within the threshold shares a bucket that one of them indexes and passes the sketch."""
    rng = random.Random(5)
    for threshold in (1, 2, 3):
        for _ in range(300):
            a = "".join(rng.choice("abcdef") for _ in range(rng.randint(8, 40)))
            b = changed(rng, a, threshold)
            if a == b or len(b) <= threshold:
                continue
            rows = {0: set(), 1: set()}
            for key, line, info in lines.bucket_rows([a, b], threshold):
                for k, n, i in zip(key.tolist(), line.tolist(), info.tolist()):
                    rows[n].add((k, i))
            assert any(x[0] == y[0] and bool(lines.may_match(np.array([x[1]]), np.array([y[1]]), threshold)[0])
                       for x in rows[0] for y in rows[1])


@pytest.mark.parametrize("threshold, block", [(2, 2000), (2, 3), (1, 2000), (3, 5)])
def test_against_all_pairs(docs_of, monkeypatch, threshold, block):
    monkeypatch.setattr(lines, "BLOCK_ROWS", block)
    rows = made(threshold)
    got = {r.doc_id: r for r in lines.line_duplicates(docs_of(rows), threshold).collect()}
    assert {k: r.removed for k, r in got.items()} == brute(rows, threshold, lines.MIN_CHARS)
    for key, text in rows:
        assert got[key].n_lines == sum(bool(x.strip()) for x in (text or "").split("\n"))
        assert got[key].n_removed == len(got[key].removed)


def test_odd_rows(docs_of, odd_texts, empty_docs):
    rows = [*enumerate(odd_texts), (None, "a line that is longer than the least\nother"), (80, "other\nkept"), (81, "a line that is longer than the last")]
    got = {r.doc_id: r.removed for r in lines.line_duplicates(docs_of(rows)).collect()}
    assert got == brute(rows, 2, lines.MIN_CHARS)
    twice = docs_of([(1, "same\ntext"), (1, "same\ntext"), (2, "text")])
    assert sorted((r.doc_id, r.removed) for r in lines.line_duplicates(twice).collect()) == [(1, []), (1, []), (2, [0])]
    assert lines.line_duplicates(empty_docs).collect() == []
    assert lines.without_repeated_lines(empty_docs).collect() == []


def test_texts_without_repeated_lines(docs_of):
    rows = [(1, "first line\n\nsecond"), (2, "first line"), (3, "new\nfirst line\nlast"), (4, None), (5, "")]
    df = docs_of(rows)
    out = lines.without_repeated_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {
        1: (rows[0][1], 18), 3: ("new\nlast", 8), 4: (None, 0), 5: ("", 0)}
