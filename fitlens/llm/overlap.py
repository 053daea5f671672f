"""Jaccard join of word n-gram sets by their count vectors.

The shingles of a set are hashed into groups; the counts of the groups are a point. Two sets share
at most the sum of the smaller of their two counts, over all groups, and an R-tree over points
keeps the largest counts of every node, so a search leaves out whatever cannot share enough.

The groups also tell which points are held against each other at all. Similar sets differ in few
shingles, and there are more groups than these can touch, so some group is equal in both.
Sets meet at equal groups, a bucket each; per bucket an R-tree is searched. The pairs that
survive are compared whole, first with the earliest that may be similar, which joins crowds
of near copies, then, in rounds, within the buckets whose sets are still apart."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlens.llm.common import written
from fitlens.llm.graph import components

SEED, WIDTH, PERCENT = 42, 3, 90
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Shingles of the sets of one bucket that a task holds at once. Larger buckets are dealt out.
PART_SHINGLES = 1 << 21
#: Points of a leaf, and nodes under a node, of the trees.
LEAF, FAN = 32, 8
#: Pairs of a set and bucket that the first round after the leaders compares at most; each round takes
#: four times as many, until none are left.
FIRST_PAIRS = 1024


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles; a text of fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    hashes = np.fromiter((xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1 if width else 0, np.uint64)
    for k in range(width):
        out = out * _BASE + hashes[k:k + len(out)]
    return np.unique(out)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return (values ^ (values >> np.uint64(32))) * _MIX


def _edges() -> list[int]:
    """Least sizes of the bands of set sizes, each half as large again as the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


EDGES = _edges()


def bands_of(n: int, percent: int) -> range:
    """The bands in which a set of n shingles is held against others: its own, and those of the
    largest sets that it can be similar to. A pair meets in the band of the larger set."""
    return range(bisect.bisect_right(EDGES, n) - 1, bisect.bisect_right(EDGES, 100 * n // percent))


def groups_of(band: int, percent: int) -> tuple[int, int]:
    """Number of groups in a band, and how many of them a set may leave empty: similar sets of the
    band differ in so few shingles that more groups than may be empty are equal."""
    differ = 2 * (EDGES[band + 1] - 1) * (100 - percent) // (100 + percent)
    spare = -(-differ // 16)
    return differ + 1 + spare, spare


def place(own: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the groups, each cut in two, and a key for each group with shingles. A set with too
    many empty groups has keys for these too."""
    n, spare = groups_of(band, percent)
    # The sets are sorted, so a group is a run of them.
    half = ((own >> np.uint64(32)) * np.uint64(2 * n)) >> np.uint64(32)
    counts = np.bincount(half.astype(np.int64), minlength=2 * n)
    in_group = counts.reshape(n, 2).sum(1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(own), dtype=np.uint64)))
    ends = np.cumsum(in_group)
    keys = _mixed((sums[ends] - sums[ends - in_group]) ^ _mixed(np.arange(n, dtype=np.uint64) + (np.uint64(band) << np.uint64(40))))
    filled = in_group > 0
    return counts, keys if (~filled).sum() > spare else keys[filled]


def _narrow(counts: np.ndarray) -> bytes:
    return counts.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if counts.max() <= np.iinfo(t).max)).tobytes()


def _wide(packed: list[bytes], n: int) -> np.ndarray:
    return np.array([np.frombuffer(b, f"<u{len(b) // n}") for b in packed]).astype(np.int64)


class RTree:
    """Points of count vectors under nodes that keep the largest count of every group, and the least
    and the largest size of a set. Built at once, by halving on the group of widest spread."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.counts, self.sizes = counts, sizes
        leaves, stack = [], [np.arange(len(sizes))]
        while stack:
            own = stack.pop()
            if len(own) <= LEAF:
                leaves.append(own)
                continue
            axes = np.column_stack((sizes[own], counts[own]))
            widest = axes[:, np.argmax(axes.max(0) - axes.min(0))]
            order = own[np.argsort(widest, kind="stable")]
            stack += [order[len(order) // 2:], order[:len(order) // 2]]
        self.leaves = leaves
        most = np.array([counts[x].max(0) for x in leaves])
        least_size, most_size = np.array([[sizes[x].min(), sizes[x].max()] for x in leaves]).T
        self.levels = [(most, least_size, most_size)]
        while len(most) > 1:
            at = np.arange(0, len(most), FAN)
            most, least_size, most_size = np.maximum.reduceat(most, at), np.minimum.reduceat(least_size, at), np.maximum.reduceat(most_size, at)
            self.levels.append((most, least_size, most_size))

    def search(self, counts: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Places of all points that may be similar to one, by the sums of the smaller counts."""
        nodes = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            most, least_size, most_size = (x[nodes] for x in self.levels[level])
            bound = np.minimum(np.minimum(most, counts).sum(1), most_size)
            nodes = nodes[bound * (100 + percent) >= percent * (size + least_size)]
            if not len(nodes):
                return nodes
            if level:
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                nodes = nodes[nodes < len(self.levels[level - 1][0])]
        points = np.concatenate([self.leaves[i] for i in nodes])
        bound = np.minimum(self.counts[points], counts).sum(1)
        return points[bound * (100 + percent) >= percent * (size + self.sizes[points])]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The neighbouring rows that share key and part, one table each."""
    held, now = [], None
    for batch in batches:
        key, part = batch.column("key").to_numpy(), batch.column("part").to_numpy()
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(key)]):
            if begin == end:
                continue
            if (key[begin], part[begin]) != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key[begin], part[begin]
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def _sid(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _described(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, _key, sid, size, places`` of every row. ``sid`` names the set of its shingles; places
    hold its point and keys in each band."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    struct = pa.struct([("band", pa.int32()), ("counts", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, sizes, places = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text, width)
                sids.append(_sid(own))
                sizes.append(len(own))
                at = []
                for band in bands_of(len(own), percent) if len(own) else ():
                    counts, keys = place(own, band, percent)
                    at.append({"band": band, "counts": _narrow(counts), "keys": keys.view(np.int64)})
                places.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_key"), pa.array(sids, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(places, pa.list_(struct))], ["doc_id", "_key", "sid", "size", "places"])

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))
    return keyed.mapInArrow(
        run, f"doc_id {kind}, _key long, sid binary, size long, places array<struct<band:int,counts:binary,keys:array<long>>>")


def _shared(sets: DataFrame) -> DataFrame:
    """``key, band, num, size, n, total, first`` of the sets that meet others. Of several buckets with the
    same sets one is enough."""
    entries = sets.select("num", "size", F.explode("places").alias("p")).select("num", "size", "p.band", F.explode("p.keys").alias("key"))
    met = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("num").alias("first"), F.sum("size").alias("total")).filter("n > 1")
    shared = written(entries.join(met, "key"))
    same = shared.groupBy("key").agg(
        F.min("band").alias("band"), F.min("n").alias("n"), F.min("first").alias("first"), F.min("total").alias("total"),
        F.bit_xor(F.xxhash64("num")).alias("x"), F.bit_xor(F.xxhash64("num", F.lit(1))).alias("y"))
    kept = same.groupBy("band", "n", "first", "total", "x", "y").agg(F.min("key").alias("key")).select("key")
    return written(shared.join(kept, "key", "left_semi"))


def _parts() -> Column:
    return F.ceil(F.col("total") / F.lit(PART_SHINGLES)).cast("int")


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "num")


def _leaders(shared: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b``: every set of a bucket with the earliest that the bound leaves. In a bucket dealt
    out over parts that is the earliest of the part, which the bucket's first set is in everywhere."""
    deal = F.when(F.col("num") == F.col("first"), F.sequence(F.lit(0), _parts() - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("num"), _parts()).cast("int")))
    rows = shared.select("key", "band", "num", F.explode(deal).alias("part")).join(points, ["num", "band"]).drop("band")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _buckets(batches):
            num, size = bucket["num"].to_numpy(), bucket["size"].to_numpy()
            if len(num) < 2:
                continue
            counts = _wide(bucket["counts"].to_pylist(), bucket["groups"][0].as_py())
            tree = RTree(counts, size)
            earliest = np.array([tree.search(counts[i], size[i], percent).min() for i in range(len(num))])
            later = np.flatnonzero(earliest < np.arange(len(num)))
            yield pa.RecordBatch.from_arrays([pa.array(num[earliest[later]]), pa.array(num[later])], ["a", "b"])

    return _by_bucket(rows).mapInArrow(run, "a long, b long").distinct()


def _whole_sets(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """``num, own``: the shingles of the sets asked for (``num, sid, _key``), from the texts."""
    rows = docs.select("text", F.xxhash64("doc_id", "text").alias("_key")).join(asked, "_key").select("num", "sid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for num, sid, text in zip(*(batch.column(c).to_pylist() for c in ("num", "sid", "text"))):
                own = shingles(text, width)
                if _sid(own) == sid:  # another row may have the same hash
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([num], pa.int64()), pa.array([own.view(np.int64)], pa.list_(pa.int64()))], ["num", "own"])

    return rows.mapInArrow(run, "num long, own array<long>").dropDuplicates(["num"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda name: sets.select(F.col("num").alias(name), F.col("own").alias(f"of_{name}"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(
        common * (100 + percent) >= percent * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def _rest(shared: DataFrame, roots: DataFrame, points: DataFrame, percent: int, low: int, high: int) -> DataFrame:
    """Pairs ``a, b`` of the buckets whose sets are not all joined yet: those outside the largest component
    of a bucket are searched for among all its other sets. Of what the bound leaves to a set the places
    from ``low`` to ``high`` are given, if not joined; a pair of a set with itself says that more follow.
    A pair that meets in several of the buckets is given in one of them."""
    # The only pair of a bucket of two has been compared.
    open_ = shared.filter("n > 2").join(roots, "num", "left").withColumn("root", F.coalesce("root", "num"))
    apart = open_.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    open_ = written(open_.join(apart, "key", "left_semi"))
    keys = open_.groupBy("num").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    largest = open_.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(
        F.max_by("root", F.struct("m", "root")).alias("largest"))
    asks = F.col("root") != F.col("largest")
    home = F.pmod(F.xxhash64("num"), _parts()).cast("int")
    rows = open_.join(largest, "key").select("key", "band", "num", "root", asks.alias("asks"), home.alias("home"), F.explode(
        F.when(asks, F.sequence(F.lit(0), _parts() - 1)).otherwise(F.array(home))).alias("part"))
    rows = rows.withColumn("here", F.col("part") == F.col("home")).drop("home").join(
        points, ["num", "band"]).drop("band").join(keys, "num")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _buckets(batches):
            num, size, root = (bucket[c].to_numpy() for c in ("num", "size", "root"))
            asks = bucket["asks"].to_numpy()
            here, asking = np.flatnonzero(bucket["here"].to_numpy()), np.flatnonzero(asks)
            if not len(here) or not len(asking):
                continue
            # Keys below that of the bucket: a pair with one of these in common meets there.
            own = bucket["key"][0].as_py()
            below = [set(keys[:bisect.bisect_left(keys, own)]) for keys in bucket["keys"].to_pylist()]
            counts = _wide(bucket["counts"].to_pylist(), bucket["groups"][0].as_py())
            tree = RTree(counts[here], size[here])
            for i in asking.tolist():
                found = np.sort(here[tree.search(counts[i], size[i], percent)])
                other = [j for j in found[low:high] if root[j] != root[i] and not (asks[j] and num[j] < num[i]) and below[i].isdisjoint(below[j])]
                other = num[[*other, i] if len(found) > high else other]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(other, num[i])), pa.array(np.maximum(other, num[i]))], ["a", "b"])

    return _by_bucket(rows).mapInArrow(run, "a long, b long").distinct()


def _joined(sets: DataFrame, points: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """``num, root`` of all sets that are similar to another: the components of all similar pairs."""
    links = written(_verified(_leaders(shared, points, percent), sets, percent))
    low, high = 0, FIRST_PAIRS
    while True:
        roots = written(components(links)).select(F.col("node").alias("num"), "root")
        pairs = written(_rest(shared, roots, points, percent, low, high))
        more = written(_verified(pairs.filter("a < b"), sets, percent))
        last = pairs.filter("a = b").isEmpty()
        if last and more.isEmpty():
            return roots
        # A set stands for all that are joined with it.
        links = roots.select(F.col("root").alias("a"), F.col("num").alias("b")).unionByName(more)
        if last:
            return written(components(links)).select(F.col("node").alias("num"), "root")
        low, high = high, 4 * high


def similar_sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``; other columns are
    ignored). Two rows link if the sets of their lower-cased word shingles have a Jaccard
    similarity of ``percent`` or more; ``component_id`` is the smallest id that links reach, the
    own one included.

    A null or empty text, or one without words, has no shingles and links with nothing; one of fewer
    words than ``width`` is one shingle. Equal rows link. Rows without id form components but do not
    name them, unless no row has one. No rows give no rows."""
    each = written(_described(docs, width, percent))
    sets = written(each.filter("size > 0").dropDuplicates(["sid"]).drop("doc_id").withColumn("num", F.monotonically_increasing_id()))
    points = sets.select("num", "size", F.explode("places").alias("p")).select("num", "size", "p.band", "p.counts")
    groups = F.element_at(F.array(*[F.lit(2 * groups_of(b, percent)[0]) for b in range(len(EDGES) - 1)]), F.col("band") + 1)
    points = points.withColumn("groups", groups)
    shared = _shared(sets)
    asked = sets.select("num", "sid", "_key").join(shared.select("num").distinct(), "num", "left_semi")
    whole = written(_whole_sets(docs, asked, width))
    shared = shared.drop("size")
    roots = _joined(whole, points, shared, percent)

    least = each.filter("size > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    rooted = written(sets.select("sid", "num").join(roots, "num", "left").join(least, "sid").select("sid", F.coalesce("root", "num").alias("root"), "least"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("sid", "component_id")
    return each.join(named, "sid", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
