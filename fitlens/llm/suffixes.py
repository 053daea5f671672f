"""Repeated substrings over a corpus by longest-previous-factor arrays.

A string of ``length`` bytes is repeated if its start has a longest previous factor of that length,
or is the earlier place of one that has. Building one suffix array over a corpus is no Spark
job, so suffixes that can match are brought together first: every window of ``length`` bytes
picks the ``GRAM`` bytes in it with the smallest hash, its anchor, and equal windows pick equal
anchors. Windows that follow each other and share an anchor form a stretch. Equal stretches
are counted before anything is shuffled by text; where an anchor has several different
stretches, their suffixes are sorted, and previous and next smaller positions in suffix order
give each suffix its longest earlier match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlens.llm.common import written

LENGTH, GRAM = 400, 128
#: Bytes that are hashed at once; a longer text is cut into parts that overlap by a window.
CHUNK = 1 << 20
#: Different stretches of one anchor whose suffixes one task sorts. The windows of an anchor with
#: more are counted one by one instead, by a hash of the whole window.
MAX_STRETCHES = 50_000
#: Groups into which the occurrences of one stretch are dealt; bits of a long.
SALTS = 64
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.uint64((1 << 24) - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of all substrings of a byte array."""

    _up, _down = _powers(_BASE, 1 << 10), _powers(_INVERSE, 1 << 10)

    def __init__(self, data: np.ndarray):
        if len(Hashes._up) <= len(data):
            Hashes._up, Hashes._down = _powers(_BASE, 2 * len(data)), _powers(_INVERSE, 2 * len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Hashes._up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * Hashes._down[start]
        value = (value ^ value >> np.uint64(31)) * _MIX
        return value ^ value >> np.uint64(29)


def stretches(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``text number, anchor place, first and last window start, anchor hash, stretch hash`` of all
    texts of at least ``length`` bytes, together under 2^24 bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    hashes = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    value = (hashes.of(at, at + gram) & ~_PLACE) | at.astype(np.uint64)
    width, size = length - gram + 1, 1
    while 2 * size <= width:
        value, size = np.minimum(value[:-size], value[size:]), 2 * size
    if size < width:
        value = np.minimum(value[:len(value) - (width - size)], value[width - size:])
    counts = sizes - length + 1
    text = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)
    anchor = (value[start] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    low, high = start[new], start[np.append(new[1:], len(start)) - 1]
    anchor, text = anchor[new], text[new]
    whole = hashes.of(low, high + length) ^ ((anchor - low).astype(np.uint64) + np.uint64(1)) * _BASE
    base = begin[text]
    return text, anchor - base, low - base, high - base, hashes.of(anchor, anchor + gram).view(np.int64), whole.view(np.int64)


def pack(anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return anchor << 24 | anchor - low << 12 | anchor - high


def unpack(place):
    anchor = place >> 24
    return anchor, anchor - (place >> 12 & 4095), anchor - (place & 4095)


def longest_previous(order: list[int], common: list[int]) -> list[int]:
    """Longest previous factors from suffix order: ``order`` lists text positions in suffix order,
    ``common`` the prefix lengths that neighbours in it share (first entry 0).

    The longest earlier match of a suffix lies at the nearest smaller position before or after
    it in suffix order; one pass with a stack finds both, with the least common prefix between."""
    best, stack = [0] * len(order), []
    for i in range(len(order) + 1):
        position = order[i] if i < len(order) else -1
        shared = common[i] if i < len(order) else 0
        while stack and order[stack[-1][0]] > position:
            k, before = stack.pop()
            best[k] = max(best[k], before, shared)
            shared = min(shared, before)
        stack.append((i, shared))
    return best


def _common(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def repeated_windows(contexts: list[bytes], anchors: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context numbers and window starts of all windows that occur in another context, and whether
    an earlier context has them. ``anchors`` are the places of the anchor in the contexts."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    data = b"".join(contexts)
    begin, counts = np.cumsum(sizes) - sizes, sizes - length + 1
    owner = np.repeat(np.arange(len(contexts)), counts)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = start + begin[owner]
    # Suffixes that share no hashed prefix of this length with another cannot match one.
    prefix = Hashes(np.frombuffer(data, np.uint8)).of(at, at + length)
    rank = np.argsort(prefix, kind="stable")
    same = prefix[rank[1:]] == prefix[rank[:-1]]
    chosen = np.sort(rank[np.append(same, False) | np.append(False, same)])
    if not len(chosen):
        return owner[:0], start[:0], np.zeros(0, bool)
    # Suffix array of the chosen starts. Positions in it are numbered as in the text.
    suffixes = [data[i:i + length] for i in at[chosen].tolist()]
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    common = [0] + [_common(suffixes[a], suffixes[b]) for a, b in zip(order, order[1:])]
    previous = np.zeros(len(order), np.int64)
    previous[order] = longest_previous(order, common)
    mirrored = np.zeros(len(order), np.int64)
    mirrored[order] = longest_previous([len(order) - 1 - p for p in order], common)
    any_match = (previous >= length) | (mirrored >= length)
    chosen, earlier = chosen[any_match], (previous >= length)[any_match]
    return owner[chosen], start[chosen], earlier


def runs(starts: np.ndarray, length: int) -> list[int]:
    """Begin and end of the bytes that windows at these sorted starts cover, as a flat list."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    begin, end = starts[np.append(0, cut)], starts[np.append(cut, len(starts)) - 1] + length
    return np.stack((begin, end), 1).ravel().tolist()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def _parts(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    for offset in range(0, max(1, len(text) - length + 1), CHUNK):
        yield offset, text[offset:offset + CHUNK + length - 1]


def _occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    narrow = _keyed(docs.select("doc_id", "text")).filter(F.octet_length("text") >= length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch, rows, offsets, texts):
            text, anchor, low, high, head, whole = stretches(texts, length, gram)
            at, shift = np.array(rows)[text], np.array(offsets)[text]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at)), batch.column("_key").take(pa.array(at)),
                 pa.array(pack(anchor + shift, low + shift, high + shift)), pa.array(head), pa.array(whole)],
                ["doc_id", "_key", "place", "anchor", "stretch"])

        for batch in batches:
            rows, offsets, texts, size = [], [], [], 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                for offset, part in _parts(text.encode(), length):
                    rows.append(i)
                    offsets.append(offset)
                    texts.append(part)
                    size += len(part)
                    if size >= CHUNK:
                        yield out(batch, rows, offsets, texts)
                        rows, offsets, texts, size = [], [], [], 0
            if texts:
                yield out(batch, rows, offsets, texts)

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, _key long, place long, anchor long, stretch long")


_RESULT = "anchor long, stretch long, every array<int>, later array<int>"


def _sorted_stretches(contexts: DataFrame, length: int) -> DataFrame:
    """Per stretch the covered bytes, relative to the anchor: of windows that occur elsewhere, and of
    those that occur earlier."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(anchor, rows):
            # Equal rows of a table bring the same stretch more than once.
            rows = sorted({r[1]: r for r in rows}.values(), key=lambda r: r[0])
            texts, places = [r[2] for r in rows], [r[3] for r in rows]
            owner, start, earlier = repeated_windows(texts, places, length)
            ids, every, later = [], [], []
            for n in np.unique(owner):
                mine = owner == n
                starts = start[mine] - places[n]
                ids.append(rows[n][1])
                every.append(runs(starts, length))
                later.append(runs(starts[earlier[mine]], length))
            return pa.RecordBatch.from_arrays(
                [pa.array([anchor] * len(ids), pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(every, pa.list_(pa.int32())), pa.array(later, pa.list_(pa.int32()))],
                ["anchor", "stretch", "every", "later"])

        now, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "doc_id", "_key", "place", "stretch", "context", "at")]
            for anchor, doc_id, key, place, *row in zip(*columns):
                row.insert(0, (doc_id is None, doc_id, key, place))
                if anchor != now:
                    if rows:
                        yield out(now, rows)
                    now, rows = anchor, []
                rows.append(row)
        if rows:
            yield out(now, rows)

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _RESULT)


def _contexts(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The text of the chosen stretches (``doc_id, _key, place, anchor, stretch``)."""
    lists = chosen.groupBy("doc_id", "_key").agg(F.collect_list(F.struct("place", "anchor", "stretch")).alias("wanted")).alias("w")
    rows = _keyed(docs.select("doc_id", "text")).alias("d").join(lists, F.col("d._key").eqNullSafe(F.col("w._key")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("_key").to_pylist()
            out: dict[str, list] = {"row": [], "_key": [], "place": [], "anchor": [], "stretch": [], "context": [], "at": []}
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                data = texts[i].encode()
                for w in wanted:
                    anchor, low, high = unpack(w["place"])
                    for name, value in zip(out, (i, keys[i], w["place"], w["anchor"], w["stretch"], data[low:high + length], anchor - low)):
                        out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            arrays = [pa.array(v, k) for v, k in zip(out.values(), kinds)]
            arrays[0] = batch.column("doc_id").take(arrays[0])
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *list(out)[1:]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("d.doc_id", "d._key", "text", "wanted").mapInArrow(
        run, f"doc_id {kind}, _key long, place long, anchor long, stretch long, context binary, at int")


def _counted_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same result for anchors with very many stretches: every window is a row of its hash."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (context, at) in enumerate(zip(batch.column("context").to_pylist(), batch.column("at").to_pylist())):
                start = np.arange(len(context) - length + 1)
                window = Hashes(np.frombuffer(context, np.uint8)).of(start, start + length).view(np.int64)
                row = pa.array(np.full(len(start), i))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(row) for c in names), pa.array(window), pa.array((start - at).astype(np.int32))],
                    [*names, "window", "start"])

    names = ["doc_id", "_key", "place", "anchor", "stretch"]
    fields = ", ".join(f"{c} {contexts.schema[c].dataType.simpleString()}" for c in names)
    windows = contexts.dropDuplicates(["anchor", "stretch"]).mapInArrow(split, f"{fields}, window long, start int")
    windows = windows.select("anchor", "stretch", "window", "start", _order().alias("one"))
    counts = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"), F.min("one").alias("first")).filter("n > 1")
    found = windows.join(counts, ["anchor", "window"]).groupBy("anchor", "stretch").agg(
        F.sort_array(F.collect_list("start")).alias("every"),
        F.sort_array(F.collect_list(F.when(F.col("one") != F.col("first"), F.col("start")))).alias("later"))
    spans = [F.flatten(F.transform(c, lambda s: F.array(s, s + length))).alias(c) for c in ("every", "later")]
    return found.select("anchor", "stretch", *spans)


def _order() -> Column:
    """Sorts by document id, null last, then key and place."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key", "place")


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, gram: int = GRAM) -> DataFrame:
    """``doc_id, _key, spans``: for each document with any, the begins and ends of byte ranges that
    strings of ``length`` bytes cover which also start elsewhere (with ``keep_first``: earlier, by
    document id, then ``_key``, then place). ``_key`` hashes id and text."""
    if not 2 * gram <= length <= 4000:
        raise ValueError("length must be between two anchors and 4000")
    found = written(_occurrences(docs, length, gram))
    salt = F.pmod(F.xxhash64("doc_id", "_key", "place"), F.lit(SALTS)).cast("int")
    classes = written(found.groupBy("anchor", "stretch").agg(
        F.count(F.lit(1)).alias("n"), F.min(_order()).alias("first"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt)).alias("salts")))
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("stretches")).filter("stretches > 1")
    # The first occurrence of a stretch stands for all of them.
    chosen = classes.join(several, "anchor").select("first.*", "anchor", "stretch", "stretches")
    contexts = _contexts(docs, chosen.filter(F.col("stretches") <= MAX_STRETCHES), length)
    matched = _sorted_stretches(contexts, length)
    crowded = chosen.filter(F.col("stretches") > MAX_STRETCHES)
    if not crowded.isEmpty():
        matched = matched.unionByName(_counted_windows(_contexts(docs, crowded, length), length))
    matched = matched.groupBy("anchor", "stretch").agg(F.first("every").alias("every"), F.first("later").alias("later"))
    hits = classes.join(matched, ["anchor", "stretch"], "left").filter("n > 1 OR every IS NOT NULL")
    # A stretch that very many documents share meets them in one group per salt that they have.
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)
    hits = hits.withColumnRenamed("first", "one").withColumn("salt", F.explode(salts)).drop("salts")
    rows = found.withColumn("salt", salt).join(hits, ["anchor", "stretch", "salt"])
    anchor = F.shiftright("place", 24)
    low, high = anchor - F.shiftright("place", 12).bitwiseAND(4095), anchor - F.col("place").bitwiseAND(4095)
    whole = F.array(low, high + length)
    partial = lambda c: F.transform(F.coalesce(c, F.array().cast("array<int>")), lambda x: anchor + x)
    is_first = _order().eqNullSafe(F.col("one"))
    if keep_first:
        spans = F.when(is_first, partial(F.col("later"))).otherwise(whole)
    else:
        spans = F.when(F.col("n") > 1, whole).otherwise(partial(F.col("every")))
    rows = rows.select("doc_id", "_key", spans.alias("spans")).filter(F.size("spans") > 0)
    return rows.groupBy("doc_id", "_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _merged(spans: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(zip(spans[::2], spans[1::2])):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row of ``docs`` (``doc_id, text``; other
    columns are ignored): the UTF-8 bytes without those in ``repeated_spans``, as binary. A null
    text counts as empty; texts shorter than ``length`` stay whole. Equal rows repeat each other;
    with ``keep_first`` rows equal in id and text count as one document."""
    narrow = _keyed(docs.select("doc_id", "text"))
    found = repeated_spans(docs, length, keep_first, gram).alias("r")
    rows = narrow.alias("d").join(found, F.col("d._key").eqNullSafe(F.col("r._key")) & F.col("d.doc_id").eqNullSafe(
        F.col("r.doc_id")), "left").select("d.doc_id", "d.text", "spans")
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, kept = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = (text or "").encode()
                merged = _merged(spans or [])
                edges = [0, *(x for s in merged for x in s), len(data)]
                sizes.append(len(data))
                removed.append(sum(e - b for b, e in merged))
                counts.append(len(merged))
                kept.append(b"".join(data[b:e] for b, e in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(counts, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
