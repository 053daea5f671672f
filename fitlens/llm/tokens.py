"""Token counts of texts under a public BPE vocabulary, by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged array of symbol ids. In every round each sequence's
best-ranked pair is merged at all its places at once, until no sequence has a pair left; the
symbols that survive are the tokens."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlens.llm.common import received, sent

MARK = "▁"
_PRETOKEN = re.compile(f"{MARK}+[^{MARK}]*")
#: Rounds after which sequences still unfinished (long runs without white space) go on with a
#: priority queue, whose cost does not grow with the square of the length.
MAX_ROUNDS = 64
CACHED_WORDS = 200_000
NONE = np.int32(1 << 30)


class Merges:
    """Pair tables of a vocabulary: ``pieces`` with ``scores``, the higher the earlier merged."""

    def __init__(self, pieces: list[str], scores: list[float]):
        ids = {p: i for i, p in enumerate(pieces)}
        order = np.unique(-np.asarray(scores), return_inverse=True)[1]
        single = np.full(0x110000, -4, np.int32)  # minus the UTF-8 bytes of a character without piece
        for limit, size in ((0x10000, -3), (0x800, -2), (0x80, -1)):
            single[:limit] = size
        for p, i in ids.items():
            if len(p) == 1:
                single[ord(p)] = i
        extra = sorted({c for p in pieces for c in p if c not in ids})
        if extra:
            raise ValueError(f"{len(extra)} characters of pieces are no pieces themselves")
        found = sorted((ids[p[:k]] << 32 | ids[p[k:]], i) for p, i in ids.items()
                       for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.single = single
        self.keys = np.array([k for k, _ in found] or [-1], np.int64)
        self.merged = np.array([i for _, i in found] or [0], np.int32)
        self.rank = order[self.merged].astype(np.int32)
        # A piece that has a pair as good as or better than its own rank: merging all its places
        # at once might overtake that pair, so only the leftmost place is merged in a round.
        left, right = self.keys >> 32, self.keys & 0xFFFFFFFF
        self.greedy = np.zeros(int(order.max(initial=0)) + 1, bool)
        for part in (left, right):
            own = order[np.maximum(part, 0)]
            self.greedy[own[self.rank <= own]] = True

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE`` if they are no pair) and merged symbol of ``a`` followed by ``b``."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(good, self.rank[at], NONE), self.merged[at]

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of every (non-empty) pre-token."""
        total = np.zeros(len(words), np.int64)
        if not words:
            return total
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.single[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        seq = np.repeat(np.arange(len(words)), sizes)
        rank, into = self.pairs(ids, np.append(ids[1:], -1))
        rank[np.cumsum(sizes) - 1] = NONE
        for _ in range(MAX_ROUNDS):
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            sizes = np.diff(np.append(starts, len(seq)))
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                weight = np.add.reduceat(np.where(ids < 0, -ids, 1), starts)
                total[seq[starts[done]]] = weight[done]
                keep = np.repeat(~done, sizes)
                ids, rank, into, seq = ids[keep], rank[keep], into[keep], seq[keep]
                sizes, best = sizes[~done], best[~done]
                if not len(sizes):
                    return total
            here = np.repeat(best, sizes)
            place = np.flatnonzero(rank == here)
            mine = seq[place]
            first = np.append(True, mine[1:] != mine[:-1])
            apart = np.append(True, np.diff(place) != 1) | first
            run = np.maximum.accumulate(np.where(apart, np.arange(len(place)), 0))
            take = ((np.arange(len(place)) - run) & 1) == 0
            take &= first | ~self.greedy[here[place]]
            place = place[take]
            ids[place] = into[place]
            stay = np.ones(len(ids), bool)
            stay[place + 1] = False
            ids, rank, into, seq = ids[stay], rank[stay], into[stay], seq[stay]
            # Only pairs at and before a new symbol have changed.
            place = place - np.arange(len(place))
            place = np.concatenate((place, place[place > 0] - 1))
            behind = np.minimum(place + 1, len(ids) - 1)
            inside = (seq[behind] == seq[place]) & (behind > place)
            rank[place], into[place] = self.pairs(ids[place], np.where(inside, ids[behind], -1))
        starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        for s, e in zip(starts, np.append(starts[1:], len(seq))):
            total[seq[s]] = self._queued(ids[s:e].tolist())
        return total

    def _queued(self, ids: list[int]) -> int:
        """The same count for one sequence, pair by pair from a priority queue."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        symbols = np.array(ids, np.int32)
        rank, into = self.pairs(symbols[:-1], symbols[1:])
        heap = [(int(r), i, i + 1, ids[i], ids[i + 1], int(to)) for i, (r, to) in
                enumerate(zip(rank, into)) if r != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, j, a, b, to = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and after[i] == j and ids[i] == a and ids[j] == b):
                continue
            ids[i], alive[j], after[i] = to, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and ids[x] >= 0 and ids[y] >= 0:
                    key = ids[x] << 32 | ids[y]
                    k = int(np.searchsorted(self.keys, key))
                    if k < len(self.keys) and self.keys[k] == key:
                        heapq.heappush(heap, (int(self.rank[k]), x, y, ids[x], ids[y], int(self.merged[k])))
        return sum(-s if s < 0 else 1 for s, a in zip(ids, alive) if a)


def read_merges(path: str) -> Merges:
    """The vocabulary of a sentencepiece BPE model without normalization, with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (
        model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Merges([model.id_to_piece(i) for i in plain], [model.get_score(i) for i in plain])


def pretokens(text: str) -> list[str]:
    """Pre-tokens without the mark that each of them starts with. No piece has a mark after
    another character, so merges never cross from one to the next."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [t[1:] for t in _PRETOKEN.findall(MARK + text.replace(" ", MARK))]


def counter(merges: Merges):
    """Function from a list of texts to their token counts. It keeps the counts of up to
    ``CACHED_WORDS`` pre-tokens, so a frequent one is merged once."""
    known: dict[str, int] = {}

    def count(texts: list[str | None]) -> list[int]:
        out, split = [], [pretokens(t or "") for t in texts]
        for begin in range(0, len(split), 200):
            part = split[begin:begin + 200]
            new = list(set().union(*part).difference(known))
            if len(known) + len(new) > CACHED_WORDS:
                known.clear()
                new = list(set().union(*part))
            known.update(zip(new, merges.count([MARK + w for w in new]).tolist()))
            out.extend(sum(map(known.__getitem__, words)) for words in part)
        return out

    return count


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs`` (``doc_id, text``; other
    columns are ignored). A null or empty text has 0 bytes and 0 tokens; equal rows get equal
    counts; no rows give no rows. The vocabulary is read once, on the driver, and is the only
    thing sent to the tasks; its size is that of the file."""
    spark = docs.sparkSession
    shared = sent(spark, read_merges(model_path))
    narrow = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(received(shared))
        for batch in batches:
            n = pa.array(count(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    counted = narrow.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
