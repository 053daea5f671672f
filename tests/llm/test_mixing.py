import duckdb
import pytest

from fitlens.llm import mixing

from tests.llm.conftest import DATA


def by_sql(table):
    con = duckdb.connect()
    con.register("documents", table)
    out = con.execute(mixing.SQL)
    names = [d[0] for d in out.description]
    return sorted((tuple(dict(zip(names, r))[c] for c in ("doc_id", "source", "size", "source_size", "target", "taken")) for r in out.fetchall()), key=str)


def got(df):
    return sorted((tuple(r) for r in mixing.mix_sources(df).collect()), key=str)


def test_whole_table(spark):
    path = f"{DATA}/documents.parquet"
    rows = got(spark.read.parquet(path))
    assert rows == by_sql(duckdb.read_parquet(path).to_arrow_table())
    by_source = {}
    for _, source, size, source_size, target, taken in rows:
        assert taken in (0, size, 2 * size, 3 * size)
        entry = by_source.setdefault(source, [target, 0, 0, source_size])
        entry[1] += taken
        entry[2] = max(entry[2], size)
    total = sum(e[3] for e in by_source.values())
    assert 0 <= total - sum(e[1] for e in by_source.values()) <= max(e[2] for e in by_source.values())
    for target, taken, largest, source_size in by_source.values():
        assert abs(taken - target) <= 1.5 * largest and target <= 3 * source_size
    assert got(spark.read.parquet(path).repartition(9)) == rows


def test_capped_targets(spark):
    """Small sources take three times their size, and what they leave goes to the others by weight."""
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 400), (None, 100)], "source string, source_size long")
    out = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert out["a"] == 30 and out[None] == 300
    assert out["b"] == pytest.approx(2 * out["c"]) and sum(out.values()) == pytest.approx(1510)


def test_odd_rows(spark, docs_of, odd_texts, empty_docs):
    df = docs_of([*enumerate(odd_texts), (None, "a b c"), (4, "one"), (4, "one")]).unionByName(
        docs_of([(i, "w " * (i % 9)) for i in range(100, 160)], source=None)).unionByName(
        docs_of([(200, "a single one")], source="z")).unionByName(docs_of([(300, None)], source="é"))
    assert got(df) == by_sql(df.toArrow())
    assert mixing.mix_sources(empty_docs).collect() == []
    nothing = docs_of([(1, None), (2, "")])
    assert [(r.target, r.taken) for r in mixing.mix_sources(nothing).collect()] == [(0.0, 0), (0.0, 0)]


def test_bins_do_not_show(spark, monkeypatch):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    want = got(df)
    for bins, last in ((1, 2), (3, 1), (1 << 20, 1 << 30)):
        monkeypatch.setattr(mixing, "BINS", bins)
        monkeypatch.setattr(mixing, "LAST_BIN", last)
        assert got(df) == want


def test_native(spark):
    plan = mixing.mix_sources(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
