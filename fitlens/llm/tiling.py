"""Benchmark decontamination by greedy string tiling.

Words that a document shares with a benchmark item seed the search: windows of ``min_tile`` words
are hashed by a running Karp-Rabin sum and looked up among those of all items. Seeds on one
diagonal join to matches; the longest match whose words are still free on both sides is marked
as a tile, again and again. An item whose words are covered by tiles up to the threshold has
leaked, in whatever order its parts come."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from fitlens.llm.common import received, sent

_WORD = re.compile(r"\w+")
MIN_TILE, COVERAGE = 5, 0.6
#: Text of benchmark items that one pass sends to the tasks; more items take more passes.
BLOCK_BYTES = 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def running_hash(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin sums of all windows."""
    out = np.zeros(max(0, len(ids) - width + 1), np.uint64)
    for k in range(width):
        out = out * _BASE + ids[k:k + len(out)].astype(np.uint64)
    return out


def tiles(item: np.ndarray, text: np.ndarray, at_item: np.ndarray, at_text: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from the seeds: ``(place in item, place in text, words)``, longest first, then
    by place. What is left of a match beside a marked tile stays a match while ``width`` long."""
    order = np.lexsort((at_item, at_text - at_item))
    i, j = at_item[order], at_text[order]
    begin = np.flatnonzero(np.append(True, (np.diff(i) != 1) | (np.diff(j) != 1)))
    size = np.diff(np.append(begin, len(i))) + width - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(size, i[begin], j[begin])
            if np.array_equal(item[a:a + n], text[b:b + n])]
    heapq.heapify(heap)
    used_item, used_text, out = np.zeros(len(item), bool), np.zeros(len(text), bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = ~(used_item[a:a - n] | used_text[b:b - n])
        if free.all():
            used_item[a:a - n] = used_text[b:b - n] = True
            out.append((a, b, -n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free, [0]))))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= width:
                heapq.heappush(heap, (s - e, a + s, b + s))
    return out


class Items:
    """Benchmark items as arrays of word numbers, and their windows by hash. An item of fewer than
    ``min_tile`` words is matched whole; one without words never matches."""

    def __init__(self, rows: list[tuple[int, str | None]], min_tile: int):
        split = [(key, words_of(text)) for key, text in rows]
        self.number = {w: i for i, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        self.items = [(key, np.array([self.number[w] for w in ws])) for key, ws in split if ws]
        self.seeds = {}
        for width in sorted({min(min_tile, len(ids)) for _, ids in self.items}):
            found = [(h, n, k) for n, (_, ids) in enumerate(self.items) if min(min_tile, len(ids)) == width
                     for k, h in enumerate(running_hash(ids, width).tolist())]
            found.sort()
            self.seeds[width] = (np.array([f[0] for f in found], np.uint64),
                                 np.array([f[1] for f in found]), np.array([f[2] for f in found]))

    def matches(self, text: str | None) -> list[tuple[int, int, float, int]]:
        """``(item id, covered words, coverage, tiles)`` of every item that shares a seed."""
        words, out = words_of(text), []
        ids = np.fromiter((self.number.get(w, -1) for w in words), np.int64, len(words))
        for width, (hashes, owner, place) in self.seeds.items():
            if len(ids) < width:
                continue
            known = np.convolve(ids >= 0, np.ones(width, int), "valid") == width
            at = np.flatnonzero(known)
            if not len(at):
                continue
            own = running_hash(ids, width)[at]
            low, high = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
            many = high - low
            if not many.any():
                continue
            row = np.repeat(at, many)
            seed = np.repeat(low, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            for n in np.unique(owner[seed]):
                mine = owner[seed] == n
                key, item = self.items[n]
                found = tiles(item, ids, place[seed[mine]], row[mine], width)
                covered = sum(t[2] for t in found)
                out.append((key, covered, covered / len(item), len(found)))
        return out


def _blocks(benchmark: DataFrame, min_tile: int, block_bytes: int) -> Iterator[Items]:
    rows, size = [], 0
    for item_id, text in benchmark.select("item_id", "text").toLocalIterator():
        rows.append((item_id, text))
        size += len((text or "").encode())
        if size >= block_bytes:
            yield Items(rows, min_tile)
            rows, size = [], 0
    if rows:
        yield Items(rows, min_tile)


def leaked_items(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, covered_words, coverage, n_tiles`` for every document row and item
    (``doc_id, text`` and ``item_id, text``; other columns are ignored) whose words the tiles cover
    to at least ``coverage``. Words are runs of letters, digits and underscores in lower case.
    Null and empty texts match nothing; equal rows give equal rows; ids may be of any plain type.

    The documents are read once for each block of items of at most ``block_bytes`` (or one item),
    so what is sent to the tasks is bounded, and no rows are shuffled."""
    spark, narrow = docs.sparkSession, docs.select("doc_id", "text")
    kinds = [narrow.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, covered_words long, coverage double, n_tiles long"
    item_kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    result = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, min_tile, block_bytes):
        shared = sent(spark, items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = received(shared)
            for batch in batches:
                rows, found = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    hits = [m for m in own.matches(text) if m[2] >= coverage]
                    rows.extend([i] * len(hits))
                    found.extend(hits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows, pa.int64())),
                     *(pa.array([m[k] for m in found], t) for k, t in
                       enumerate((item_kind, pa.int64(), pa.float64(), pa.int64())))],
                    ["doc_id", "item_id", "covered_words", "coverage", "n_tiles"])

        result = result.unionByName(narrow.mapInArrow(run, schema))
    return result


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``leaked_items`` finds nothing in."""
    spark = docs.sparkSession
    for items in _blocks(benchmark, min_tile, block_bytes):
        shared = sent(spark, items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = received(shared)
            for batch in batches:
                at = batch.schema.get_field_index("text")
                clean = [all(m[2] < coverage for m in own.matches(t)) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
