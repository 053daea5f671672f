"""URL filters: rules for hosts and paths, and gradient-boosted trees on lexical features. DataFrame
and SQL functions only.

A tree is grown level by level. Each level is one aggregate: sums of gradients by leaf, feature
and bin, from which the driver reads the best split of every leaf. The rows that it runs over are
not URLs but cells: distinct combinations of binned features, with their counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlens.llm.common import let, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict, host and path of each rule. A rule's name is its host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labelled URLs that the trees are fitted on at most, about; they are chosen by hash.
SAMPLE = 200_000
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 12, 3, 0.3, 16, 20, 1.0
#: Pseudo-count of labelled URLs that pulls the statistics of a host suffix to the overall rate.
PRIOR = 20.0
FEATURES = ("length", "host_length", "depth", "digits", "entropy", "parameters", "hyphens", "labels", "suffix_rate")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits the host or a parent domain of it and the
    begin of the path; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(begin)
        name, verdict = F.when(fits, domain + begin).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    def of(t):
        n = F.length(t)
        shares = F.transform(F.array_distinct(F.split(t, "")), lambda c: (n - F.length(F.replace(t, c, F.lit("")))) / n)
        return F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))
    return F.when(F.length(text) > 0, let(text, of)).otherwise(0.0)


def lexical(df: DataFrame) -> DataFrame:
    """``df`` with ``host, path, suffix`` and the lexical features of ``url`` but the suffix rate."""
    host, path = host_and_path(F.col("url"))
    url = F.coalesce("url", F.lit(""))
    df = df.withColumns({"host": host, "path": path})
    return df.withColumns({
        "suffix": F.substring_index("host", ".", -1),
        "length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "digits": F.coalesce(F.try_divide(F.length(url) - F.length(F.translate(url, "0123456789", "")), F.length(url)), F.lit(0.0)),
        "entropy": F.round(_entropy(url), 9),
        "parameters": (F.length(url) - F.length(F.translate(url, "=", ""))).cast("double"),
        "hyphens": (F.length("host") - F.length(F.translate("host", "-_", ""))).cast("double"),
        "labels": F.size(F.split("host", "[.]")).cast("double"),
    })


def _with_suffix_rate(df: DataFrame, rates: DataFrame, overall: float) -> DataFrame:
    return df.join(rates, "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(overall)))


def _binned(df: DataFrame, edges: list[list[float]]) -> DataFrame:
    """Adds ``b0..``: how many edges of a feature lie below its value."""
    return df.withColumns({f"b{i}": sum((F.when(F.col(f) > e, 1).otherwise(0) for e in cuts), F.lit(0))
                           for i, (f, cuts) in enumerate(zip(FEATURES, edges))})


def tree_value(tree: dict) -> Column:
    if "value" in tree:
        return F.lit(tree["value"])
    return F.when(F.col(f"b{tree['feature']}") <= tree["bin"], tree_value(tree["left"])).otherwise(tree_value(tree["right"]))


def _leaf(tree: dict) -> Column:
    if "leaf" in tree:
        return F.lit(tree["leaf"])
    return F.when(F.col(f"b{tree['feature']}") <= tree["bin"], _leaf(tree["left"])).otherwise(_leaf(tree["right"]))


def _best_split(bins: list[tuple], total: list[float]) -> tuple | None:
    """``(feature, bin, sums left, sums right)`` of the largest gain; ``bins`` are sorted rows of
    feature, bin, count, gradient and curvature."""
    best, gained, left, feature = None, 1e-6, [0.0, 0.0, 0.0], -1
    for f, b, *part in bins:
        if f != feature:
            feature, left = f, [0.0, 0.0, 0.0]
        left = [x + y for x, y in zip(left, part)]
        right = [x - y for x, y in zip(total, left)]
        if min(left[0], right[0]) < LEAST:
            continue
        gain = sum(sign * x[1] ** 2 / (x[2] + RIDGE) for sign, x in ((1, left), (1, right), (-1, total)))
        if gain > gained + 1e-9:
            best, gained = (f, b, left, right), gain
    return best


def _grow(cells: DataFrame) -> dict:
    """One tree for the gradients ``g`` and curvatures ``h`` of the cells (counts ``n``)."""
    root: dict = {"leaf": 0}
    totals, open_leaves, ended = {}, [root], []
    features = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"b{i}").alias("bin")) for i in range(len(FEATURES))]))
    for _ in range(DEPTH):
        rows = cells.withColumn("leaf", _leaf(root)).select("leaf", "n", "g", "h", features.alias("f"))
        sums = sorted(tuple(r) for r in rows.groupBy("leaf", "f.feature", "f.bin").agg(
            F.sum("n"), F.round(F.sum("g"), 9), F.round(F.sum("h"), 9)).collect())
        below = []
        for leaf in open_leaves:
            number = leaf["leaf"]
            mine = [r[1:] for r in sums if r[0] == number]
            total = totals.setdefault(number, [math.fsum(r[k] for r in mine if r[0] == 0) for k in (2, 3, 4)])
            split = _best_split(mine, total)
            if split is None:
                ended.append(leaf)
                continue
            del leaf["leaf"]
            new = len(totals)
            leaf.update(feature=split[0], bin=split[1], left={"leaf": number}, right={"leaf": new})
            totals[number], totals[new] = split[2], split[3]
            below += [leaf["left"], leaf["right"]]
        open_leaves = below
        if not open_leaves:
            break
    for leaf in ended + open_leaves:
        total = totals[leaf.pop("leaf")]
        leaf["value"] = round(-RATE * total[1] / (total[2] + RIDGE), 9)
    return root


class Model:
    """Base score, bin edges and trees, and the suffix rates as a table."""

    def __init__(self, base: float, edges: list[list[float]], trees: list[dict], rates: DataFrame | None, overall: float):
        self.base, self.edges, self.trees, self.rates, self.overall = base, edges, trees, rates, overall

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``host, path`` and ``risk``, the probability that a URL is to be blocked."""
        columns = df.columns
        if not self.trees:
            host, path = host_and_path(F.col("url"))
            return df.withColumns({"host": host, "path": path, "risk": F.lit(1 / (1 + math.exp(-self.base)))})
        rows = _binned(_with_suffix_rate(lexical(df), self.rates, self.overall), self.edges)
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + tree_value(tree)
        return rows.select(*columns, "host", "path", (1 / (1 + F.exp(-total))).alias("risk"))


def fit(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES) -> Model:
    """Boosts trees on ``url, bad`` (1 or 0). All labelled URLs up to about ``sample``, beyond that as
    many by hash of the URL. Without both kinds of label the model is the smoothed rate alone."""
    known = labelled.filter("bad IS NOT NULL AND url IS NOT NULL").select("url", "bad")
    n = known.count()
    if n > sample:
        known = known.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < F.lit((sample << 30) // n))
    rows = written(lexical(known))
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = (bad + 0.5) / (n + 2.0)
    base = math.log(overall / (1 - overall))
    if bad in (0, n):
        return Model(base, [], [], None, overall)
    rates = written(rows.groupBy("suffix").agg(
        ((F.sum("bad") + PRIOR * overall) / (F.count(F.lit(1)) + PRIOR)).alias("suffix_rate")))
    rows = _with_suffix_rate(rows, rates, overall)
    cuts = rows.agg(*[F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 10_000).alias(f) for f in FEATURES]).first()
    edges = [sorted(set(cuts[f])) for f in FEATURES]
    bins = [f"b{i}" for i in range(len(FEATURES))]
    cells = written(_binned(rows, edges).groupBy(*bins).agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")).withColumn(
        "score", F.lit(base)))
    grown = []
    for _ in range(trees):
        p = 1 / (1 + F.exp(-F.col("score")))
        tree = _grow(cells.withColumns({"g": F.col("n") * p - F.col("bad"), "h": F.col("n") * p * (1 - p)}))
        grown.append(tree)
        cells = written(cells.withColumn("score", F.col("score") + tree_value(tree)))
    return Model(base, edges, grown, rates, overall)


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, bad``: the pages whose path ends in the number of a labelled document; bad if that is of
    low quality or toxic."""
    _, path = host_and_path(F.col("url"))
    number = F.regexp_extract(path, r"/(\d{1,18})(?:\.html)?/?$", 1)
    rows = pages.select("url", number.alias("_n"))
    rows = rows.filter("_n <> ''").select("url", F.col("_n").cast("bigint").alias("_doc"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(
        F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    kinds = labels.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return rows.join(kinds, F.col("_doc") == F.col("doc_id")).select("url", "bad")


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``page_id, host, path, rule, verdict, risk`` for every row of ``pages`` (``page_id, url``; other
    columns are ignored). The verdict is that of the longest rule that fits, else block if the
    trees give at least ``threshold``. A null URL, or one without ``://``, has empty host and path
    and is judged by the trees. Equal rows get equal verdicts."""
    rows = fit(labelled, sample).score(pages.select("page_id", "url"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("risk") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "risk")
