"""Near-duplicates of the pipeline: Jaccard 0.8 or more of the sets of five-word shingles.

Two sets as similar as that share one of the first fifth of their shingles, in whatever order all
sets are sorted. Shingles are ordered from rare to common, so few documents meet at one, and
those are compared by size, place, parities and at last by their whole sets. Only pairs that
pass the last test link, and no test before it leaves out a similar pair.

The vantage-point search of ``simhash`` comes first: sets whose fingerprints it joins are compared
whole, and those that are similar link. A radius of bits that covers 0.8 leaves vantage-point blocks
of a few bits, whose look-ups would reach most shards; so the shingles look for what is left, which is
only pairs that the fingerprints have not joined yet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlens.llm.common import written
from fitlens.llm.graph import components
from fitlens.llm.simhash import _LOWER, SEED, close_links, keep_rows

WIDTH = 5
#: Longs of the parities of a set: bit k says if an odd number of its shingles falls into cell k.
PARITIES = 16
#: Documents whose shingles tell rare from common ones, cells that they are counted in, as a power of
#: two, and those of one block. The order decides how many pairs are compared, never which are found.
SAMPLE, CELLS, BLOCK = 50_000, 22, 12
#: Documents that meet at one shingle, above which one of them is compared with the others first;
#: then only pairs are left that this has not joined.
CROWD = 64
#: Cells, as a power of two, of the map of documents to be read again, which every task holds as bits.
WANTED = 24
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    hashes = np.fromiter((xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    out = np.zeros(len(words) - width + 1 if width else 0, np.uint64)
    for k in range(width):
        out = out * _BASE + hashes[k:k + len(out)]
    return np.unique(out)


def simhash_of(shingle_set: np.ndarray) -> np.uint64:
    ones = np.unpackbits(shingle_set.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingle_set), bitorder="little").view("<u8")[0]


def parities_of(shingle_set: np.ndarray) -> np.ndarray:
    """A shingle that only one of two sets holds changes one parity, so sets differ in at least as many
    shingles as parities."""
    cell = (shingle_set & np.uint64(64 * PARITIES - 1)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=64 * PARITIES) & 1, bitorder="little").view("<i8")


def _id_of(shingle_set: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(shingle_set.tobytes())).view(np.int64))


def _common(docs: DataFrame) -> np.ndarray:
    """How often the sample has the shingles of each cell, in steps of an eighth of a doubling; 0: once at most.

    Tasks put the steps of a block of cells into one row, so the driver gets a byte a cell."""
    n = docs.count()
    share = int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))
    cells, width = 1 << CELLS, 1 << min(BLOCK, CELLS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int32)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(total, (shingles(text) >> np.uint64(64 - CELLS)).astype(np.int64), 1)
        for block, own in enumerate(total.reshape(-1, width)):
            if len(cell := np.flatnonzero(own)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([cell.astype(np.int32)], pa.list_(pa.int32())),
                     pa.array([own[cell]], pa.list_(pa.int32()))], ["block", "cells", "n"])

    def steps(rows: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for cell, n in zip(rows.column("cells").chunks, rows.column("n").chunks):
            np.add.at(total, cell.flatten().to_numpy(), n.flatten().to_numpy())
        step = np.rint(8 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pa.table({"block": rows.column("block")[:1], "steps": pa.array([step.tobytes()], pa.binary())})

    sample = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(share))
    counted = sample.select("text").mapInArrow(count, "block long, cells array<int>, n array<int>").groupBy("block").applyInArrow(
        steps, "block long, steps binary").toArrow()
    out = np.zeros((cells // width, width), np.uint8)
    for block, step in zip(counted.column("block").to_pylist(), counted.column("steps")):
        out[block] = np.frombuffer(step.as_buffer(), np.uint8)
    return out.ravel()


def _described(docs: DataFrame) -> DataFrame:
    """``doc_id, _key, sid, size, fp, odd, prefix`` of every row: ``sid`` names the set of its shingles, ``odd``
    has its parities, ``prefix`` the rarest shingles, among which a similar set must have one too."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, sizes, fps, odds, prefixes = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text)
                n = len(own)
                order = np.lexsort((own, shared.value[(own >> np.uint64(64 - CELLS)).astype(np.int64)]))
                sids.append(_id_of(own))
                sizes.append(n)
                fps.append(simhash_of(own) if n else np.uint64(0))
                odds.append(parities_of(own))
                prefixes.append(own[order[:n - -(-4 * n // 5) + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_key"), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(odds, pa.list_(pa.int64())),
                 pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "_key", "sid", "size", "fp", "odd", "prefix"])

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))
    return keyed.mapInArrow(run, f"doc_id {kind}, _key long, sid long, size long, fp long, odd array<long>, prefix array<long>")


def _may_be_similar() -> Column:
    """For rows a and b that meet at a shingle: all similar pairs pass at their first common one."""
    both = F.col("a.size") + F.col("b.size")
    left = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    differ = sum((F.bit_count(F.col("a.odd")[k].bitwiseXOR(F.col("b.odd")[k])) for k in range(PARITIES)), F.lit(0))
    return (5 * F.least("a.size", "b.size") >= 4 * F.greatest("a.size", "b.size")) & (9 * left >= 4 * both) & (9 * differ <= both)


def _marked(keys: DataFrame) -> np.ndarray:
    """Bits of the cells that ``_key`` of the rows fall into, 64 in an entry: 2 MB, however many rows."""
    marked = keys.selectExpr(f"shiftrightunsigned(_key, {64 - WANTED}) AS cell").selectExpr(
        "shiftright(cell, 6) AS word", "shiftleft(1L, CAST(cell & 63 AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (WANTED - 6), np.uint64)
    out[marked.column("word").to_numpy()] = marked.column("bits").to_numpy().view(np.uint64)
    return out


def _similar(pairs: DataFrame, each: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of set names whose sets have Jaccard 0.8 or more, compared whole.

    The texts are not joined to the names, which would shuffle all of them: tasks read them where they lie and
    pass on the sets of marked documents. Sets that nobody asked for share a cell by chance and find no pair."""
    pairs = written(pairs.distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    keys = each.join(asked, "sid", "left_semi").groupBy("sid").agg(F.min("_key").alias("_key"))
    marked = docs.sparkSession.sparkContext.broadcast(_marked(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("_key").to_numpy().view(np.uint64) >> np.uint64(64 - WANTED)
            wanted = marked.value[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1)
            for text in batch.column("text").take(pa.array(np.flatnonzero(wanted))).to_pylist():
                own = shingles(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_id_of(own)], pa.int64()), pa.array([own.view(np.int64)], pa.list_(pa.int64()))], ["sid", "own"])

    rows = docs.select("text", F.xxhash64("doc_id", "text").alias("_key"))
    sets = written(rows.mapInArrow(run, "sid long, own array<long>").dropDuplicates(["sid"]))
    compared = pairs.join(sets.select(F.col("sid").alias("a"), F.col("own").alias("of_a")), "a").join(
        sets.select(F.col("sid").alias("b"), F.col("own").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return written(compared.filter(9 * common >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b"))


def _near_in_bits(sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of set names to compare: the sets of one fingerprint with the first of them, and the
    first sets of fingerprints that the vantage-point search joins."""
    firsts = sets.groupBy("fp").agg(F.min(F.struct("sid", "size")).alias("f")).select("fp", "f.*")
    same = firsts.alias("a").join(sets.alias("b"), (F.col("a.fp") == F.col("b.fp")) & (F.col("a.sid") != F.col("b.sid")))
    links = written(close_links(firsts.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb")))
    close = links.join(firsts.alias("a"), F.col("fa") == F.col("a.fp")).join(firsts.alias("b"), F.col("fb") == F.col("b.fp"))
    sizes = 5 * F.least("a.size", "b.size") >= 4 * F.greatest("a.size", "b.size")
    pair = F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b")
    return same.filter(sizes).select(*pair).unionByName(close.filter(sizes).select(*pair))


def similar_links(each: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges ``a, b`` between set names (``sid``) whose components are those of all similar pairs."""
    sets = written(each.dropDuplicates(["sid"]).select("sid", "size", "fp", "odd", "prefix"))
    near = _similar(_near_in_bits(sets.filter("size > 0").select("sid", "size", "fp")), each, docs)
    joined = written(components(near)).select(F.col("node").alias("sid"), "root")
    index = sets.select("sid", F.posexplode("prefix").alias("at", "shingle")).select("shingle", "sid", "at")
    met = index.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("first")).filter("n > 1")
    met = written(index.join(met, "shingle"))
    met = met.join(sets.select("sid", "size", "odd"), "sid").join(joined, "sid", "left")
    met = written(met.withColumn("near", F.coalesce("root", "sid")).drop("root"))
    few, crowds = met.filter(F.col("n") <= CROWD), met.filter(F.col("n") > CROWD)
    names = F.col("a.sid").alias("a"), F.col("b.sid").alias("b")
    meet = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.near") != F.col("b.near"))

    pairs = few.alias("a").join(few.alias("b"), meet & (F.col("a.sid") < F.col("b.sid")) & _may_be_similar()).select(*names)
    firsts = crowds.filter("sid = first")
    stars = firsts.alias("a").join(crowds.alias("b"), meet & (F.col("a.sid") != F.col("b.sid")) & _may_be_similar()).select(*names)
    links = near.unionByName(_similar(pairs.unionByName(stars), each, docs))
    if crowds.isEmpty():
        return links
    joined = written(components(links)).select(F.col("node").alias("sid"), "root")
    crowds = written(crowds.join(joined, "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    # A shingle whose documents are all joined has nothing left to find.
    apart = crowds.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    crowds = written(crowds.join(apart.select("shingle"), "shingle", "left_semi"))
    pairs = crowds.alias("a").join(
        crowds.alias("b"), meet & (F.col("a.sid") < F.col("b.sid")) & (F.col("a.root") != F.col("b.root")) & _may_be_similar()).select(*names)
    return links.unionByName(_similar(pairs, each, docs))


def one_of_similar(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay when each component of similar texts
    keeps one: the one of the smallest id (null last). Texts without words are alike."""
    each = written(_described(docs))
    roots = written(components(similar_links(each, docs))).select(F.col("node").alias("sid"), "root")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    by_set = each.groupBy("sid").agg(F.min(first).alias("first"))
    winners = by_set.join(roots, "sid", "left").groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("first").alias("first"))
    return keep_rows(docs, winners)
