import ast
import os

import corpus_pipeline
from fitlens.llm import lines, mixing, outliers, tiling
from fitlens.llm.common import written

from tests.llm.conftest import DATA
from tests.llm.test_similar import brute as similar_brute


def test_stages_against_brute_force(spark):
    """Each stage on all that the one before it kept, held against plain Python."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, rows = docs, {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, DATA))
        after = {r.doc_id: r for r in docs.collect()}
        seen.append((name, len(rows), len(after)))
        if name != "mixing":
            assert docs.columns == columns
        if name == "quality rules":
            assert set(after) == {r.doc_id for r in outliers.quality_verdicts(before).collect() if r.kept}
        if name == "line dedup":
            gone = line_brute_fast(rows)
            want = {}
            for k, r in rows.items():
                text = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[k])
                if text.strip() or not gone[k]:
                    want[k] = (text, len(text))
            assert {k: (r.text, r.n_chars) for k, r in after.items()} == want
        if name == "SimHash near-dedup":
            assert sorted(after) == similar_brute([(k, r.text) for k, r in rows.items()])
        if name == "benchmark decontamination":
            leaked = {r.doc_id for r in tiling.leaked_items(before, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
            assert set(after) == set(rows) - leaked
        if name == "mixing":
            assert {k: tuple(r) for k, r in after.items()} == {r.doc_id: tuple(r) for r in mixing.mix_sources(before).collect()}
    assert all(kept <= all_ for _, all_, kept in seen) and seen[-1][2] > 100


def line_brute_fast(rows):
    """All pairs, but for lines whose lengths or ends rule a match out."""
    first = {}
    for key in sorted(rows):
        for k, line in enumerate(rows[key].text.split("\n")):
            if line.strip(" \t\n\v\f\r"):
                first.setdefault(line, (key, k))
    by_length = {}
    for line in first:
        if len(line) >= lines.MIN_CHARS:
            by_length.setdefault(len(line), []).append(line)
    late = {a for n, own in by_length.items() for a in own for m in range(n - 2, n + 3) for b in by_length.get(m, ())
            if first[b] < first[a] and lines.within(a, b, 2) <= 2}
    return {key: {k for k, line in enumerate(r.text.split("\n")) if line.strip(" \t\n\v\f\r") and (line in late or first[line] != (key, k))}
            for key, r in rows.items()}


def test_run_repeats(spark):
    once = sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect()))
    assert once and once == sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect()))


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert "op6_mix_sources" in __spark_entry__.oracle_sql()


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder, _, files in os.walk(os.path.join(root, "fitlens")):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    for node in ast.walk(ast.parse(f.read())):
                        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [
                            node.module or ""] if isinstance(node, ast.ImportFrom) else []
                        assert not any(n.startswith("fitlens.llm") for n in names), (folder, name)
