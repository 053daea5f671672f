"""Quality rules: base counts of every text, and robust multivariate outliers. DataFrame and SQL
functions only.

Per language and source, the minimum covariance determinant estimate is approached by
concentration steps: start from medians, take the half of the rows that lie nearest, take their
mean and covariance as the new centre and shape, and repeat. A document whose transformed
statistics lie further from the centre than the cutoff, in Mahalanobis distance, is rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitlens.llm.common import SPACE, let, n_words, written

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of a group that the estimate rests on, concentration steps, and the squared distance
#: beyond which a document is rejected (chi-square with four degrees of freedom passes it once
#: in about 10^8 clean documents).
SUPPORT, STEPS, CUTOFF = 0.5, 4, 42.0
#: Standard deviation of each statistic below which a group is never taken to lie. Most groups
#: have statistics that are zero throughout their nearest half; without a floor, any other
#: value would be infinitely far away.
FLOORS = (0.1, 0.25, 0.05, 0.08)
GROUPS = ("lang", "source")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Distances are ranked in bins of this many to a unit of their logarithm.
BINS = 50


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text has at least twice."""
    def windows(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(
            F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(starts):
        steps = F.zip_with(starts, F.slice(starts, F.lit(2), F.size(starts)), lambda a, b: F.least(
            F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def repeated(hashes):
        def starts(pairs):
            def same(i, j):
                return F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
            at = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: F.coalesce(
                same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            return F.array_sort(F.transform(at, lambda i: F.get(pairs, i)["i"]))

        def heavy(h):
            pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            return let(let(pairs, starts), covered)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(heavy(hashes))

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows(w), repeated)))


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``
    and the helper columns ``_chars`` and ``_upper``. A null text counts as empty. Windows of
    words are compared by 64-bit hash within one text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.regexp_replace(text, SPACE + "+", "")
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE + "+", "")) > 0)
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = docs.withColumns({
        "n_words": n_words(F.col("text")), "word_chars": F.length(bare).cast("long"),
        "n_symbols": _count_of(text, SYMBOLS).cast("long"), "n_dup_lines": dup.cast("long"),
        "n_repeat_words": _repeat_words(words).cast("long"),
        "_upper": _count_of(text, UPPER).cast("long"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _statistics() -> list[Column]:
    """The transformed statistics: log of the mean word length, log of symbols per hundred words,
    square root of the share of capitals, share of repeated words."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
            F.log1p(100 * F.col("n_symbols") / words),
            F.sqrt(F.col("_upper") / F.greatest(F.col("word_chars"), F.lit(1))),
            F.col("n_repeat_words") / words]


def _distance(k: int) -> Column:
    """Squared Mahalanobis distance of ``x0..`` from ``m0..`` under the Cholesky factor ``l<i><j>``,
    by forward substitution."""
    ys: list[Column] = []
    for i in range(k):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * ys[j]
        ys.append(rest / F.col(f"l{i}{i}"))
    total = ys[0] * ys[0]
    for y in ys[1:]:
        total = total + y * y
    return total


def _factor(shape: DataFrame, k: int, floors) -> DataFrame:
    """Adds the Cholesky factor of the covariances ``c<i><j>`` with the floors on the diagonal,
    one column after the other so that no expression is repeated."""
    for i in range(k):
        for j in range(i + 1):
            value = F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0))
            if i == j:
                value = value + F.lit(floors[i] ** 2)
            for n in range(j):
                value = value - F.col(f"l{i}{n}") * F.col(f"l{j}{n}")
            if i == j:
                value = F.sqrt(F.greatest(value, F.lit(floors[i] ** 2 / 4)))
            else:
                value = value / F.col(f"l{j}{j}")
            shape = shape.withColumn(f"l{i}{j}", value)
    return shape


def _with_shape(rows: DataFrame, shape: DataFrame, groups, k: int) -> DataFrame:
    on = [F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}")) for g in groups]
    keep = [f"m{i}" for i in range(k)] + [f"l{i}{j}" for i in range(k) for j in range(i + 1)]
    joined = rows.alias("r").join(shape.alias("s"), on, "left")
    return joined.select("r.*", *[F.col(f"s.{c}") for c in keep])


def estimate(base: DataFrame, groups, k: int, floors=FLOORS, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """Centre and shape (``m0..``, ``l00..``) of each group of ``base`` (``x0..`` and group columns).

    Every step is an aggregate by group, summed up in the tasks before the shuffle, so the size
    of a group does not matter. The nearest rows are found by counting binned distances."""
    start = base.groupBy(*groups).agg(*[F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in range(k)])
    spread = start.withColumns({f"c{i}{j}": F.lit(0.0) for i in range(k) for j in range(i + 1)})
    shape = _factor(spread, k, floors)
    for _ in range(steps):
        near = _with_shape(base, shape, groups, k).withColumn(
            "bin", F.floor(F.log1p(_distance(k)) * BINS).cast("int"))
        counts = near.groupBy(*groups, "bin").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(f"x{i}").alias(f"s{i}") for i in range(k)],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(k) for j in range(i + 1)])
        by = Window.partitionBy(*groups)
        before = F.coalesce(F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inner = counts.withColumn("before", before).withColumn("all", F.sum("n").over(by)).filter(
            F.col("before") < F.ceil(F.col("all") * support))
        sums = inner.groupBy(*groups).agg(
            F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)],
            *[F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i in range(k) for j in range(i + 1)])
        means = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(k)})
        # The nearest half of a normal sample in four dimensions has a smaller spread than the
        # whole; twice its covariance is about the whole one.
        shape = _factor(means.withColumns({
            f"c{i}{j}": 2 * (F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
            for i in range(k) for j in range(i + 1)}), k, floors)
        shape = written(shape.select(*groups, *[f"m{i}" for i in range(k)],
                                     *[f"l{i}{j}" for i in range(k) for j in range(i + 1)]))
    return shape


def _measured(docs: DataFrame) -> DataFrame:
    return base_counts(docs).withColumns({f"x{i}": x for i, x in enumerate(_statistics())})


def _judged(rows: DataFrame, shape: DataFrame, cutoff: float) -> DataFrame:
    """``rows`` with ``distance``, the squared robust Mahalanobis distance, and ``kept``."""
    far = _with_shape(rows, shape, GROUPS, len(FLOORS)).withColumn("distance", _distance(len(FLOORS)))
    # One expression, not a conjunction: Spark would push the first part of that below the join and
    # take the counts a second time there.
    return far.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(
        F.coalesce(F.col("distance") <= cutoff, F.lit(True))))


def quality_verdicts(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``distance`` and ``kept`` for every row of ``docs``
    (``doc_id, text, lang, source``; other columns are ignored).

    Null languages and sources are groups of their own. A null or empty text fails the base
    rules. Rows that fail the base rules do not shape the estimate of their group; where all of
    a group fail there is none, and distance is null. Equal rows get equal verdicts."""
    rows = written(_measured(docs.select("doc_id", "text", *GROUPS)).drop("text"))
    judged = _judged(rows, estimate(rows.filter("NOT base_failed"), GROUPS, len(FLOORS)), cutoff)
    return judged.select("doc_id", *COUNTS, "base_failed", "distance", "kept")


def kept_documents(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality_verdicts`` keeps. The counts are taken
    twice, once for the estimate and once for the verdict, so that no text is written or shuffled."""
    # Written before it is filtered, as the filter would take the counts a second time.
    narrow = written(_measured(docs.select("text", *GROUPS)).drop("text"))
    shape = estimate(narrow.filter("NOT base_failed"), GROUPS, len(FLOORS))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select("_row", "_row.text", *[f"_row.{g}" for g in GROUPS])
    return _judged(_measured(rows), shape, cutoff).filter("kept").select("_row.*")
