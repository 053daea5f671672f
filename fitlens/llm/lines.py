"""Line deduplication across documents by a segment-partition edit join.

Two lines within ``threshold`` edits, the shorter cut into ``threshold + 1`` segments, share a
segment that no edit touches, at a place that the difference of their lengths bounds. Every
line is indexed under its segments and looked up under the substrings of each length that may
equal a segment. Rows of an index bucket are compared by a count sketch of characters; what
is left is verified by banded bit-parallel edit distance on the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlens.llm.common import SPACE, written

_BLANK = " \t\n\v\f\r"
THRESHOLD, MIN_CHARS = 2, 25
#: Rows of an index bucket that are compared at once. A larger bucket is cut into blocks of this
#: many, and every pair of blocks is a group of its own.
BLOCK_ROWS = 2000
#: Distinct lines that a task remembers so as not to emit them again.
REMEMBERED = 300_000
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A bucket row's flag of an index entry, above the sketch of 15 counts modulo 4.
INDEXED = 1 << 30
CLASSES = 15


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def bucket_rows(lines: list[str], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket keys, line numbers and flagged sketches of lines longer than ``threshold``."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    begin = np.cumsum(sizes) - sizes
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * _powers(_BASE, len(codes)), dtype=np.uint64)))
    back = _powers(_INVERSE, len(codes) + 1)
    kind = ((codes * _MIX) >> np.uint64(40)).astype(np.int64) % CLASSES
    counts = np.bincount(np.repeat(np.arange(len(lines)), sizes) * CLASSES + kind, minlength=len(lines) * CLASSES)
    sketch = ((counts.reshape(-1, CLASSES) & 3) << (2 * np.arange(CLASSES))).sum(1)
    parts = threshold + 1
    for delta in range(threshold + 1):
        short = sizes - delta
        base, odd = short // parts, short % parts
        for i in range(parts):
            place = i * base + np.maximum(0, i - (parts - odd))
            size = base + (i >= parts - odd)
            for shift in range(max(-i, delta - (threshold - i)), min(i, delta + (threshold - i)) + 1):
                start = place + shift
                line = np.flatnonzero((start >= 0) & (start + size <= sizes) & (size > 0))
                s = begin[line] + start[line]
                value = (sums[s + size[line]] - sums[s]) * back[s]
                value ^= (short[line] * parts + i).astype(np.uint64) * _MIX
                value = (value ^ value >> np.uint64(31)) * _MIX
                flag = INDEXED if delta == 0 and shift == 0 else 0
                yield (value ^ value >> np.uint64(29)).view(np.int64), line, (sketch[line] | flag).astype(np.int32)


_BYTE = np.arange(256)
_FIELDS = np.stack([_BYTE >> (2 * k) & 3 for k in range(4)])
_APART = np.minimum((_FIELDS[:, :, None] - _FIELDS[:, None, :]) % 4, (_FIELDS[:, None, :] - _FIELDS[:, :, None]) % 4).sum(0).astype(np.uint8)


def may_match(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Whether one of two bucket rows is an index entry and their sketches allow ``threshold`` edits:
    an edit changes at most two counts by one."""
    near = _APART[a & 255, b & 255].astype(np.int16)
    for k in (8, 16):
        near += _APART[a >> k & 255, b >> k & 255]
    near += _APART[a >> 24 & 63, b >> 24 & 63]
    return (near <= 2 * threshold) & ((a | b) & INDEXED > 0)


def within(a: str, b: str, limit: int) -> int:
    """Edit distance of two texts if at most ``limit``, else ``limit + 1``.

    Bit-parallel within a band of ``2 * limit + 1`` diagonals: bit ``k`` of the state after ``e``
    edits says that the diagonal's reach is met at this row (automaton simulation row by row)."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    n = min(len(a), len(b))
    k = 0
    while k < n and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    n, k = min(len(a), len(b)), 0
    while k < n and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[:len(a) - k], b[:len(b) - k]
    if not a or not b:
        return min(max(len(a), len(b)), limit + 1)
    # Row i of the table keeps columns i - limit .. i + limit as bits; level e holds the cells
    # reachable with at most e edits.
    width = 2 * limit + 1
    every = (1 << width) - 1
    place: dict[str, int] = {}
    for j, c in enumerate(b):
        place[c] = place.get(c, 0) | 1 << j
    cells = [0] * (limit + 1)
    for e in range(limit + 1):  # row 0: column j needs j insertions
        for j in range(min(e, len(b)) + 1):
            cells[e] |= 1 << (j + limit)
    for i, c in enumerate(a, 1):
        offset = i - limit - 1  # bit 0 of this row's band is column offset + 1
        at = place.get(c, 0)
        match = at >> offset if offset >= 0 else at << -offset
        inside = every
        if offset + 1 < 0:
            inside &= every << (-offset - 1)
        if offset + width > len(b):
            inside &= (1 << max(0, len(b) - offset)) - 1
        new = []
        for e in range(limit + 1):
            # Diagonal step keeps the bit, a deletion comes from the bit above, an insertion from below.
            now = cells[e] & match
            if e:
                now |= cells[e - 1] | cells[e - 1] >> 1 | new[e - 1] << 1
            new.append(now & inside)
        cells = new
        if not cells[limit]:
            return limit + 1
    goal = 1 << (len(b) - len(a) + limit)
    return next((e for e in range(limit + 1) if cells[e] & goal), limit + 1)


def _lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def _digest(line: str) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(line.encode())


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def _occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, _key, line_no, id, line`` for each line with a word: a 128-bit digest and half of it."""
    narrow = _with_key(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, digests = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for k, line in enumerate(_lines(text)):
                    if line.strip(_BLANK):
                        rows.append(i)
                        numbers.append(k)
                        digests.append(_digest(line))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("_key").take(at), pa.array(numbers, pa.int32()),
                 pa.array(digests, pa.binary()), pa.array(np.frombuffer(b"".join(digests), np.int64)[::2])],
                ["doc_id", "_key", "line_no", "id", "line"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, _key long, line_no int, id binary, line long")


def _fresh_lines(min_chars: int):
    """Function from a batch of texts to lists of its longer lines that this task has not given yet."""
    seen: set[bytes] = set()

    def take(texts: list[str | None], chars: int = 1 << 19) -> Iterator[tuple[list[str], list[bytes]]]:
        lines, digests, size = [], [], 0
        for text in texts:
            for line in _lines(text):
                if len(line) >= min_chars and line.strip(_BLANK) and (d := _digest(line)) not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(d)
                    lines.append(line)
                    digests.append(d)
                    size += len(line)
            if size >= chars:
                yield lines, digests
                lines, digests, size = [], [], 0
        if lines:
            yield lines, digests

    return take


def _ids(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64)[::2]


def _pairs(key: np.ndarray, line: np.ndarray, info: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of rows, sorted by key, that share a key."""
    first, second, rows, step = [], [], np.arange(len(key)), 0
    while len(rows):
        step += 1
        rows = rows[rows + step < len(key)]
        rows = rows[key[rows] == key[rows + step]]
        good = rows[may_match(info[rows], info[rows + step], threshold) & (line[rows] != line[rows + step])]
        first.append(line[good])
        second.append(line[good + step])
    if not first:
        return line[:0], line[:0]
    a, b = np.concatenate(first), np.concatenate(second)
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _candidates(docs: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """``a, b``: pairs of lines that share a bucket and whose sketches are close."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _fresh_lines(max(min_chars, threshold + 1))
        for batch in batches:
            for lines, digests in fresh(batch.column("text").to_pylist()):
                ids = _ids(digests)
                for key, line, info in bucket_rows(lines, threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[line]), pa.array(info)], ["key", "line", "info"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, key=None, info=None, block=None):
            n = len(a)
            zeros = np.zeros(n, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(b), pa.array(zeros if key is None else key),
                 pa.array(zeros.astype(np.int32) if info is None else info),
                 pa.array((zeros - 1).astype(np.int32) if block is None else block)], ["a", "b", "key", "info", "block"])

        # The last key of a batch may go on in the next. A key with many rows is passed on in
        # blocks instead of being compared here; ``given`` counts those of the key at hand.
        held, given, given_key = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)], 0, None

        def large(key, line, info):
            nonlocal given, given_key
            if given_key != key[0]:
                given, given_key = 0, key[0]
            block = ((given + np.arange(len(key))) // BLOCK_ROWS).astype(np.int32)
            given += len(key)
            return out(line, line, key, info, block)

        def work(key, line, info):
            cuts = np.flatnonzero(np.diff(key)) + 1
            begin, end = np.append(0, cuts), np.append(cuts, len(key))
            big = (end - begin > BLOCK_ROWS) | (key[begin] == given_key if given_key is not None else False)
            for s, e in zip(begin[big], end[big]):
                yield large(key[s:e], line[s:e], info[s:e])
            small = np.repeat(~big, end - begin)
            a, b = _pairs(key[small], line[small], info[small], threshold)
            if len(a):
                yield out(a, b)

        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("key", "line", "info")]
            held = [np.concatenate(x) for x in zip(held, new)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield from work(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
            if len(held[0]) > BLOCK_ROWS:
                yield large(*held)
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from work(*held)

    rows = docs.select("text").mapInArrow(emit, "key long, line long, info int")
    found = written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(
        search, "a long, b long, key long, info int, block int"))
    pairs, large = found.filter("block < 0").select("a", "b"), found.filter("block >= 0")
    if not large.isEmpty():
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(held):
                sides = [tuple(np.concatenate([h[s][k] for h in held]) for k in (0, 1)) for s in (0, 1)]
                (la, ia), (lb, ib) = sides
                if len(la) and len(lb):
                    for i in range(0, len(la), 500):
                        q, m = np.nonzero(may_match(ia[i:i + 500, None], ib[None, :], threshold))
                        a, b = la[i + q], lb[m]
                        good = a != b
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[good]), pa.array(np.maximum(a, b)[good])], ["a", "b"])

            now, held = None, []
            for batch in batches:
                key, low, high, block, line, info = (batch.column(c).to_numpy() for c in ("key", "low", "high", "block", "a", "info"))
                cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
                for s, e in zip([0, *cuts], [*cuts, len(key)]):
                    if s == e:
                        continue
                    if (key[s], low[s], high[s]) != now:
                        if held:
                            yield from out(held)
                        now, held = (key[s], low[s], high[s]), []
                    lo, hi = block[s:e] == low[s], block[s:e] == high[s]
                    held.append(((line[s:e][lo], info[s:e][lo]), (line[s:e][hi], info[s:e][hi])))
            if held:
                yield from out(held)

        blocks = large.groupBy("key").agg((F.max("block") + 1).alias("n"))
        spread = large.join(blocks, "key").select("key", "a", "info", "block", F.explode(
            F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).select(
            "key", "a", "info", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        pairs = pairs.unionByName(spread.repartition("key", "low", "high").sortWithinPartitions(
            "key", "low", "high").mapInArrow(compare, "a long, b long"))
    return pairs.distinct()


def similar_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``id_a, id_b``: pairs of different lines, both of at least ``min_chars`` characters, within
    ``threshold`` edits of each other. Lines are named by their 128-bit digest."""
    pairs = written(_candidates(docs, threshold, min_chars))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _fresh_lines(max(min_chars, threshold + 1))
        for batch in batches:
            for lines, digests in fresh(batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_ids(digests)), pa.array(digests, pa.binary()), pa.array(lines, pa.string())], ["line", "id", "chars"])

    texts = written(docs.select("text").mapInArrow(emit, "line long, id binary, chars string").join(
        wanted, "line", "left_semi").groupBy("id").agg(F.first("line").alias("line"), F.first("chars").alias("chars")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("chars_a").to_pylist(), batch.column("chars_b").to_pylist()
            good = pa.array([x != y and within(x, y, threshold) <= threshold for x, y in zip(a, b)], pa.bool_())
            yield batch.select(["id_a", "id_b"]).filter(good)

    side = {s: texts.select(F.col("line").alias(s), F.col("id").alias(f"id_{s}"), F.col("chars").alias(f"chars_{s}")) for s in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b")
    return both.select("id_a", "chars_a", "id_b", "chars_b").mapInArrow(verify, "id_a binary, id_b binary").distinct()


def removed_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, _key, removed``: numbers (from 0) of the lines to remove, for documents with any.

    A line goes if the same line, or one within ``threshold`` edits (both of ``min_chars`` or more
    characters), starts earlier, by document id (null last), then line number. Lines without a
    word stay. ``_key`` hashes id and text; rows equal in both are one document here."""
    lines = written(_occurrences(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key", "line_no")
    first = written(lines.groupBy("id").agg(F.min(order).alias("first")))
    links = similar_lines(docs, threshold, min_chars)
    both = links.select(F.explode(F.array(F.struct(F.col("id_a").alias("id"), F.col("id_b").alias("other")),
                                          F.struct(F.col("id_b").alias("id"), F.col("id_a").alias("other")))).alias("e")).select("e.*")
    later = both.join(first, "id").join(first.select(F.col("id").alias("other"), F.col("first").alias("than")), "other").filter(
        "than < first").select("id").distinct().withColumn("late", F.lit(True))
    # Written, so that the join with all occurrences reads two plain tables: Spark can then split
    # the partition of a line that very many documents share.
    kept = written(first.join(later, "id", "left").filter("late IS NULL").select("id", F.col("first").alias("kept_at")))
    return lines.withColumn("at", order).join(kept, "id", "left").filter("kept_at IS NULL OR at <> kept_at").groupBy(
        "doc_id", "_key").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def line_duplicates(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` for every row of ``docs`` (``doc_id, text``; other columns
    are ignored): lines with a word, and the numbers of those that ``removed_lines`` removes. A
    null or empty text has no lines."""
    has_word = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(F.regexp_replace(x, SPACE + "+", "")) > 0)
    rows = _with_key(docs.select("doc_id", "text")).select("doc_id", "_key", F.size(has_word).cast("long").alias("n_lines")).alias("d")
    gone = removed_lines(docs, threshold, min_chars).alias("r")
    joined = rows.join(gone, F.col("d._key").eqNullSafe(F.col("r._key")) & F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")), "left")
    removed = F.coalesce(F.col("removed"), F.array().cast("array<int>"))
    return joined.select("d.doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with all columns, its texts without the lines that ``removed_lines`` removes, ``n_chars``,
    where there is one, the length of what is left. A document that loses every line goes with
    them; one that had none stays as it is."""
    gone = removed_lines(docs, threshold, min_chars).select(F.col("doc_id").alias("_id"), "_key", "removed")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64("doc_id", "text").alias("_own"))
    joined = rows.join(gone, (F.col("_own") == F.col("_key")) & F.col("_row.doc_id").eqNullSafe(F.col("_id")), "left")
    left = F.filter(F.split("_row.text", "\n"), lambda x, i: ~F.array_contains(F.col("removed"), i))
    untouched = F.col("removed").isNull()
    text = F.when(untouched, F.col("_row.text")).otherwise(F.array_join(left, "\n"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(untouched, F.col("_row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    rest = untouched | (F.length(F.regexp_replace(text, SPACE + "+", "")) > 0)
    return joined.filter(rest).select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
