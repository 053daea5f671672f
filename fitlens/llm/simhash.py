"""SimHash near-duplicates: exact search for close fingerprints in shards of vantage-point trees.

A fingerprint has three blocks of bits. Two fingerprints that differ in at most 4 bits differ in
at most 1 bit of some block, so every block is searched for neighbours at distance 1. For each
block a vantage-point tree, built on a bounded sample, cuts the fingerprints into shards: a node
sends those within its radius of its vantage point to one side and the rest to the other. Each
fingerprint lives in one shard and is looked up in every shard that the triangle inequality does
not rule out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlens.llm.common import received, sent, written
from fitlens.llm.graph import components

SEED, WIDTH, MAX_BITS = 42, 4, 4
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Fingerprints that a tree is built on, fingerprints per shard aimed at, and the most levels.
SAMPLE, PER_SHARD, MAX_LEVELS = 20_000, 1500, 16
#: Members of one shard that a task holds; a larger shard is cut into parts, each of which gets
#: all look-ups of the shard.
PART_ROWS = 20_000
#: Pairs compared at once. In a crowd of close fingerprints all of them may be links.
COMPARED = 1 << 18


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[i:i + 4096], ends[i:i + 4096])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` and ``fp`` (the 64 bits as a signed long) for every row of ``docs``."""
    narrow = docs.select(*carry, "text")
    fields = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(fp)], [*carry, "fp"])

    return narrow.mapInArrow(run, f"{fields}, fp long")


def _blocks(max_bits: int) -> tuple[list[np.uint64], int]:
    """Masks of bits, and the most differing bits of the closest block: ``max_bits // count``."""
    count = max(1, (max_bits + 2) // 2) if max_bits > 1 else 1
    edges = np.linspace(0, 64, count + 1).astype(int)
    return [np.uint64(((1 << int(b)) - 1) ^ ((1 << int(a)) - 1)) for a, b in zip(edges, edges[1:])], max_bits // count


class Tree:
    """Vantage points and radii of a complete binary tree over one block of bits."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, levels: int):
        self.mask, self.levels = mask, levels
        self.points = np.zeros((1 << levels) - 1, np.uint64)
        self.radii = np.zeros((1 << levels) - 1, np.int64)
        groups = [sample & mask]
        for level in range(levels):
            below = []
            for k, group in enumerate(groups):
                node = (1 << level) - 1 + k
                # The vantage point of the widest spread among a few candidates of the group.
                tries = group[:: max(1, len(group) // 8)][:8] if len(group) else np.zeros(1, np.uint64)
                best = max(tries, key=lambda v: np.bitwise_count(group ^ v).std() if len(group) else 0)
                distance = np.bitwise_count(group ^ best)
                radius = int(np.median(distance)) if len(group) else 0
                if len(group) and np.mean(distance <= radius) > 0.6 and np.any(distance < radius):
                    radius -= 1
                self.points[node], self.radii[node] = best, radius
                below += [group[distance <= radius], group[distance > radius]]
            groups = below

    def home(self, fps: np.ndarray) -> np.ndarray:
        """Shard of every fingerprint."""
        at, value = np.zeros(len(fps), np.int64), fps & self.mask
        for level in range(self.levels):
            node = (1 << level) - 1 + at
            at = 2 * at + (np.bitwise_count(value ^ self.points[node]) > self.radii[node])
        return at

    def lookups(self, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and shards: all shards that may hold something within ``reach`` of a row."""
        row, at = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        value = fps & self.mask
        for level in range(self.levels):
            node = (1 << level) - 1 + at
            distance = np.bitwise_count(value[row] ^ self.points[node]).astype(np.int64)
            inner, outer = distance - reach <= self.radii[node], distance + reach > self.radii[node]
            row = np.concatenate((row[inner], row[outer]))
            at = np.concatenate((2 * at[inner], 2 * at[outer] + 1))
        return row, at


class Forest:
    """Union-find over the places of an array, joined by arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            while not np.array_equal(root[root], root):
                root = root[root]
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root[root], root):
            root = root[root]
        self.root = root


def links_of(members: np.ndarray, asked: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs (asked, member) that differ in at most ``max_bits``: edges
    that join exactly the same fingerprints as all those pairs do."""
    every = np.unique(np.concatenate((members, asked)))
    forest = Forest(len(every))
    at_member, at_asked = np.searchsorted(every, members), np.searchsorted(every, asked)
    step = max(1, COMPARED // max(1, len(members)))
    for i in range(0, len(asked), step):
        close = np.bitwise_count(asked[i:i + step, None] ^ members[None, :]) <= max_bits
        q, m = np.nonzero(close)
        forest.join(at_asked[i + q], at_member[m])
    other = np.flatnonzero(forest.root != np.arange(len(every)))
    return every[other], every[forest.root[other]]


def close_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``a, b`` between distinct values of ``fps`` (``fp``) whose components are those of all
    pairs within ``max_bits`` bits. A shard gives fewer edges than it has fingerprints."""
    spark = fps.sparkSession
    n = fps.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).toArrow()
    sample = np.sort(sample.column("fp").to_numpy().view(np.uint64)) if n else np.zeros(0, np.uint64)
    masks, reach = _blocks(max_bits)
    levels = min(MAX_LEVELS, max(0, int(np.ceil(np.log2(max(1, n) / PER_SHARD)))))
    # At most 2^16 nodes for each of a few blocks: the size does not depend on the corpus.
    shared = sent(spark, [Tree(sample, m, levels) for m in masks])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = received(shared)
        totals = np.zeros((len(trees), 1 << levels), np.int64)
        for batch in batches:
            own = batch.column("fp").to_numpy().view(np.uint64)
            for k, tree in enumerate(trees):
                totals[k] += np.bincount(tree.home(own), minlength=1 << levels)
        k, shard = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(shard), pa.array(totals[k, shard])], ["k", "shard", "n"])

    counted = fps.select("fp").mapInArrow(homes, "k long, shard long, n long").groupBy("k", "shard").agg(
        F.sum("n").alias("n")).toArrow()
    parts = np.ones((len(masks), 1 << levels), np.int64)
    parts[counted.column("k").to_numpy(), counted.column("shard").to_numpy()] = -(
        -counted.column("n").to_numpy() // PART_ROWS)
    shared_parts = spark.sparkContext.broadcast(parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = received(shared)
        for batch in batches:
            own = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(own), 2000):
                some = own[i:i + 2000]
                for k, tree in enumerate(trees):
                    home = tree.home(some)
                    row, at = tree.lookups(some, reach)
                    many = shared_parts.value[k]
                    own_part = (some * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many[home]
                    copies = many[at]
                    row, at = np.repeat(row, copies), np.repeat(at, copies)
                    every = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate((home, at)) << 3 | k), pa.array(np.concatenate((own_part, every))),
                        pa.array(np.repeat([False, True], [len(home), len(at)])),
                        pa.array(np.concatenate((some, some[row])).view(np.int64))], ["shard", "part", "asks", "fp"])

    placed = fps.select("fp").mapInArrow(place, "shard long, part long, asks boolean, fp long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(members, asked):
            if not members or not asked:
                return
            a, b = links_of(np.unique(np.concatenate(members)).view(np.uint64),
                            np.unique(np.concatenate(asked)).view(np.uint64), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        # Rows come sorted by shard and part, members before look-ups; look-ups are worked off
        # in blocks, so a task holds one part of one shard and one block.
        now, members, asked, held = None, [], [], 0
        for batch in batches:
            shard, part = batch.column("shard").to_numpy(), batch.column("part").to_numpy()
            asks, fp = batch.column("asks").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy()
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(shard)]):
                if s == e:
                    continue
                if (shard[s], part[s]) != now or held > 200_000:
                    yield from out(members, asked)
                    if (shard[s], part[s]) != now:
                        now, members = (shard[s], part[s]), []
                    asked, held = [], 0
                members.append(fp[s:e][~asks[s:e]])
                asked.append(fp[s:e][asks[s:e]])
                held += e - s
        yield from out(members, asked)

    grouped = placed.repartition("shard", "part").sortWithinPartitions("shard", "part", "asks")
    return grouped.mapInArrow(search, "a long, b long").distinct()


def _classes(each: DataFrame, max_bits: int) -> DataFrame:
    """``fp, root`` for every distinct fingerprint: ``root`` names its component."""
    distinct = written(each.select("fp").distinct())
    found = written(components(close_links(distinct, max_bits)))
    return distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (``doc_id, text``; other columns
    are ignored). Fingerprints link at ``max_bits`` or fewer differing bits; ``component_id`` is
    the smallest id that links reach. A null or empty text has fingerprint zero and links like
    any other. Rows without id form components but do not name them, unless no row has one."""
    each = written(fingerprints(docs))
    classes = _classes(each, max_bits)
    least = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = written(classes.join(least, "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return each.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_rows(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``winners`` (``first``: id and hash of id and text) name, each once."""
    # One key of both, in which two null ids are equal: rows are dealt out once, for the join and for the copies.
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("hash"))
    # The hash is never null; said so, both keys are of one type, and a cast would have rows dealt twice.
    hashed = F.coalesce("first._key", F.lit(0).cast("long"))
    winners = winners.select(F.struct(F.col("first.doc_id").alias("id"), hashed.alias("hash")).alias("_key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_own"))
    return rows.join(winners, F.col("_own") == F.col("_key"), "left_semi").dropDuplicates(["_own"]).select("_row.*")


def one_of_each(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay when each component keeps one: the one of
    the smallest id (null last). Of rows equal in id and text one stays."""
    key = F.xxhash64("doc_id", "text")
    each = written(fingerprints(docs.select("doc_id", "text", key.alias("_key")), ("doc_id", "_key")))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    by_fp = each.groupBy("fp").agg(F.min(first).alias("first"))
    winners = _classes(each, max_bits).join(by_fp, "fp").groupBy("root").agg(F.min("first").alias("first"))
    return keep_rows(docs, winners)
