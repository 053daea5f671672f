import random

from fitlens.llm import urls

from tests.llm.conftest import DATA


def plain(url):
    """Host, path and rule as the definitions say."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(d + p, v) for v, d, p in urls.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return host, path, max(fits, key=lambda r: len(r[0]), default=(None, None))


def check(rows):
    for r in rows:
        host, path, (name, verdict) = plain(r.url)
        assert (r["host"], r.path, r.rule) == (host, path, name)
        assert r.verdict == (verdict or ("block" if r.risk >= 0.5 else "allow"))


def made(spark, n=1200):
    rng = random.Random(1)
    return spark.createDataFrame([
        (i, f"http://win-{rng.randrange(99999)}.biz/a?x={i}&y=2" if i % 3 == 0 else f"https://site{rng.randrange(50)}.org/en/news/{i}", i % 3 == 0, "x", 1.0)
        for i in range(n)], "page_id long, url string, bad boolean, suffix string, length double").selectExpr("page_id", "url", "int(bad) AS bad", "suffix", "length")


def test_trees_learn_held_out_urls(spark):
    df = made(spark)
    got = urls.judge(df, df.filter("page_id < 600"), rules=()).collect()
    assert sorted(r.page_id for r in got) == list(range(1200))
    assert all((r.verdict == "block") == (r.page_id % 3 == 0) for r in got)


def test_sampled_fit(spark):
    df = made(spark)
    got = urls.judge(df, df, rules=(), sample=300).collect()
    assert sum((r.verdict == "block") == (r.page_id % 3 == 0) for r in got) >= 1190


def test_rules_and_odd_urls(spark):
    df = made(spark)
    odd = [None, "", "no", "HTTP://A.Example.NET/en/x?y#z", "x://net", "x://net/", "a://b://c/d", "http://org/fr/", "http://xorg/fr/",
           "http://É.org/fr/a", "http://example.com/de/\nq", "http://a.example.com?/de/", "http://e.net/" + "9" * 20_000, "x://net/"]
    pages = spark.createDataFrame([(i, u, "p", "q") for i, u in enumerate(odd)], "page_id long, url string, host string, verdict string")
    labels = df.filter("page_id < 300")
    got = urls.judge(pages, labels).join(pages.select("page_id", "url"), "page_id").collect()
    assert len(got) == len(odd)
    check(got)
    one_kind = urls.judge(pages, labels.filter("bad = 0")).collect()
    assert {r.risk for r in one_kind}.pop() < 0.5 and len(one_kind) == len(odd)
    assert urls.judge(pages.limit(0), labels.limit(0)).collect() == []


def test_whole_table(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    labelled = urls.labelled_urls(pages, labels)
    assert set(r.bad for r in labelled.collect()) == {0, 1}
    result = urls.judge(pages, labelled)
    check(result.join(pages.select("page_id", "url"), "page_id").collect())
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
