import hashlib
import random

import pyarrow as pa
import pytest

from fitlens.llm import middle
from fitlens.llm.queries import op11_fill_in_middle

from tests.llm.conftest import DATA


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    pre, mid, suf = text[:low], text[low:high], text[high:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", low, high - low, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", low, high - low, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 20])
def test_cut_at_any_slice_size(size):
    rng = random.Random(size)
    texts = ["".join(rng.choice("aé漢😀\n\0 ") for _ in range(rng.choice([0, 0, 1, 2, 9, 50]))) for _ in range(60)]
    low = [rng.randint(0, len(t)) for t in texts]
    high = [rng.randint(a, len(t)) for a, t in zip(low, texts)]
    got = middle.cut(pa.array(["skipped é", *texts])[1:], pa.array(low, pa.int64()), pa.array(high, pa.int64()), size)
    want = [[t[:a] for t, a in zip(texts, low)], [t[a:b] for t, a, b in zip(texts, low, high)], [t[b:] for t, b in zip(texts, high)]]
    assert [piece.to_pylist() for piece in got] == want


def test_odd_rows_and_round_trip(docs_of, odd_texts):
    near_markers = ["a<P>b", "<S", "<<S>", "P><M", "<S<P", "M>x<", "<" * 40, ">" * 40, "S>" * 30]
    rows = list(enumerate([*odd_texts, *near_markers * 12])) + [(None, "no id here"), (None, None), (3, "another text of the same id")]
    out = middle.fill_in_middle(docs_of(rows))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = [tuple(r) for r in out.withColumn("back", middle.restored(out.output, out.form)).collect()]
    assert sorted(map(repr, got)) == sorted(repr((*brute(k, t), t or "")) for k, t in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_large_batch_is_sliced(docs_of, monkeypatch):
    monkeypatch.setattr(middle, "SLICE_BYTES", 64)
    rows = [(k, "wörd " * (k % 40)) for k in range(300)]
    got = [tuple(r) for r in middle.fill_in_middle(docs_of(rows)).collect()]
    assert sorted(got) == sorted(brute(k, t) for k, t in rows)


def test_string_ids_and_empty(spark, empty_docs):
    assert middle.fill_in_middle(empty_docs).collect() == []
    docs = spark.createDataFrame([("a-1", "some text"), (None, "x")], "doc_id string, text string")
    assert sorted(map(repr, map(tuple, middle.fill_in_middle(docs).collect()))) == sorted(
        repr(brute(k, t)) for k, t in [("a-1", "some text"), (None, "x")])


def test_whole_table(spark):
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        *head, output = brute(r.doc_id, r.text)
        want[r.doc_id] = (*head, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = op11_fill_in_middle(spark, DATA)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert {r.doc_id: tuple(r) for r in got.collect()} == want
