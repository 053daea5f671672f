"""Language identification by unigram piece models, marginalised over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. The probability of
a word is the sum over all its segmentations into pieces, by the forward algorithm; the model is
fitted to labelled texts by expectation maximisation with the same sums."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlens.llm.common import written

MARK = "▁"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Places of a group of words whose lattices are held at once; a longer word is a group of its own.
GROUP = 64_000
#: Sums below this are brought back into the range of doubles, looked for at every so many places.
SMALL, EVERY = 1e-60, 8
#: Probability of a character that no piece has, in every language.
UNKNOWN = 1e-8
#: Labelled documents per language that a model is fitted on (chosen by hash), rounds of
#: expectation maximisation, and the count added to every piece.
SAMPLE, ROUNDS, SMOOTH = 4000, 3, 0.05
CACHED_WORDS = 200_000


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


class Lattice:
    """Finds the pieces at every place of a word, by a trie held as a sorted array."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        nodes, edges, ends = {"": 0}, {}, [-1]
        for i, p in enumerate(pieces):
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    ends.append(-1)
                    edges[nodes[p[:k - 1]] << 21 | ord(p[k - 1])] = nodes[p[:k]]
            ends[nodes[p]] = i
        keys = sorted(edges)
        self.keys = np.array(keys or [-1], np.int64)
        self.to = np.array([edges[k] for k in keys] or [0], np.int64)
        self.ends = np.array(ends, np.int32)
        self.longest = max(map(len, pieces), default=1)

    def matches(self, words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Lengths with the mark before each word, and for every piece length the words, places
        and pieces that match. Characters without a piece match the extra piece ``len(pieces)``."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        codes = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at, node, out = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        for length in range(1, self.longest + 1):
            ok = place[at] + length <= sizes[word[at]]
            at, node = at[ok], node[ok]
            key = node << 21 | codes[at + length - 1]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[edge] == key
            piece = np.full(len(at), -1, np.int32)
            piece[ok] = self.ends[self.to[edge[ok]]]
            if length == 1:
                piece[piece < 0] = len(self.pieces)
            hit = piece >= 0
            out.append((word[at[hit]], place[at[hit]], piece[hit]))
            at, node = at[ok], self.to[edge[ok]]
            if not len(at):
                break
        return sizes, out

    def grid(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths, and ``[length - 1, place, word]`` -> piece, ``len(pieces) + 1`` where none."""
        sizes, found = self.matches(words)
        cells = np.full((len(found), int(sizes.max()), len(words)), len(self.pieces) + 1, np.int32)
        for k, (word, place, piece) in enumerate(found):
            cells[k, place, word] = piece
        return sizes, cells


def _extended(p: np.ndarray) -> np.ndarray:
    """Piece probabilities with those of an unknown character and of no piece."""
    return np.concatenate([p, np.full((*p.shape[:-1], 1), UNKNOWN), np.zeros((*p.shape[:-1], 1))], axis=-1)


def _by_length(words: list[str], size: int = 2000) -> Iterator[np.ndarray]:
    """Groups of words of like lengths, of up to ``size`` words and about ``GROUP`` places."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    begin = 0
    while begin < len(order):
        longest = sizes[order[begin:begin + size]] + 2
        fits = np.flatnonzero(longest * np.arange(1, len(longest) + 1) <= GROUP)
        end = begin + (fits[-1] + 1 if len(fits) else 1)
        yield order[begin:end]
        begin = end


def _raised(pending: np.ndarray, scale: np.ndarray) -> None:
    """Brings sums that are still added to (along the first axis) into range, and notes it in ``scale``."""
    most = pending.max(0)
    low = (most > 0) & (most < SMALL)
    if low.any():
        pending[:, low] /= most[low]
        scale[low] += np.log(most[low])


def word_scores(lattice: Lattice, p: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probability of every word in every language: the sum over all segmentations, of a word of any
    length. Only the places that a piece can reach are held, and no probability leaves its range."""
    table, out = np.ascontiguousarray(_extended(p).T), np.zeros((len(words), len(p)))
    for chosen in _by_length(words):
        sizes, cells = lattice.grid([words[i] for i in chosen])
        steps, places, n = cells.shape
        # The sums at a place and at those after it, in turn.
        alpha, scale = np.zeros((steps + 1, n, len(p))), np.zeros((n, len(p)))
        alpha[0] = 1
        for i in range(places + 1):
            ends = np.flatnonzero(sizes == i)
            if len(ends):
                out[chosen[ends]] = np.log(alpha[i % (steps + 1), ends]) + scale[ends]
            if i == places:
                break
            here = alpha[i % (steps + 1)].copy()
            alpha[i % (steps + 1)] = 0
            for k in range(min(steps, places - i)):
                alpha[(i + k + 1) % (steps + 1)] += here * table[cells[k, i]]
            if i % EVERY == EVERY - 1:
                _raised(alpha, scale)
    return out


def expected_pieces(lattice: Lattice, p: np.ndarray, words: list[str], lang: np.ndarray, times: np.ndarray) -> np.ndarray:
    """``[language, piece]``: how often pieces are expected in the words, each ``times`` over."""
    table, width = _extended(p), len(lattice.pieces) + 2
    out = np.zeros(table.size)
    for chosen in _by_length(words):
        sizes, cells = lattice.grid([words[i] for i in chosen])
        steps, places, n = cells.shape
        own, every = lang[chosen], np.arange(n)
        alpha, beta = np.zeros((places + 1, n)), np.zeros((places + 1, n))
        # Logarithms of what the sums at each place were divided by.
        over_alpha, over_beta = np.zeros((places + 1, n)), np.zeros((places + 1, n))
        alpha[0], beta[sizes, every] = 1, 1
        prob = table[own[None, None, :], cells]
        scale = np.zeros(n)
        for i in range(places):
            over_alpha[i] = scale
            for k in range(min(steps, places - i)):
                alpha[i + k + 1] += alpha[i] * prob[k, i]
            if i % EVERY == EVERY - 1:
                _raised(alpha[i + 1:i + 1 + steps], scale)
        scale = np.zeros(n)
        for i in range(places - 1, -1, -1):
            over_beta[i + 1] = scale
            for k in range(min(steps, places - i)):
                beta[i] += beta[i + k + 1] * prob[k, i] * np.exp(over_beta[i + k + 1] - scale)
            if i % EVERY == 0:
                _raised(beta[i:i + 1], scale)
        over_beta[0] = scale
        total = np.log(beta[0]) + over_beta[0]
        for i in range(places):
            for k in range(min(steps, places - i)):
                with np.errstate(over="ignore"):
                    moved = np.exp(over_alpha[i] + over_beta[i + k + 1] - total)
                share = alpha[i] * prob[k, i] * beta[i + k + 1]
                share = np.where(share > 0, share * moved, 0.0) * times[chosen]
                out += np.bincount(own * width + cells[k, i], share, minlength=table.size)
    return out.reshape(table.shape)[:, :-2]


def read_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model that consist of letters in lower case, with or without the
    mark of a word's begin."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    bare = [(p, p.removeprefix(MARK)) for p in pieces]
    return [p for p, b in bare if p == MARK or (_LETTERS.fullmatch(b) and b == b.lower())]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, pieces: list[str], sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and ``[language, piece]`` probabilities from ``doc_id, text, lang``.

    Fitted on up to about ``sample`` documents of each language, chosen by a hash of id and
    text; only documents with text and language whose crc32 says so take part. Words are counted
    per language by Spark, each round sums expected piece counts by language and piece, and the
    driver holds one row per language and piece."""
    spark = docs.sparkSession
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    # The share to take of each language is a literal of the plan, so texts are not shuffled.
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, float(sample << 30) / n)]) if sizes else None
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")]
                          if sizes else F.lit(False)).select("lang", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found = words_of(text)
                langs.extend([lang] * len(found))
                words.extend(found)
            counted = pa.table({"lang": pa.array(langs, pa.string()), "word": pa.array(words, pa.string())}).group_by(
                ["lang", "word"]).aggregate([([], "count_all")]).rename_columns(["lang", "word", "n"])
            yield from counted.cast(pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])).to_batches()

    counts = written(chosen.mapInArrow(split, "lang string, word string, n long").groupBy(
        "lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(sizes)
    number = {lang: i for i, lang in enumerate(langs)}
    p = np.tile(np.array([10.0 ** -(len(x.removeprefix(MARK)) + 1) for x in pieces]), (len(langs), 1))
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast((pieces, number, p))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_pieces, own_number, own_p = shared.value
            lattice, total = Lattice(own_pieces), np.zeros(own_p.shape)
            for batch in batches:
                if batch.num_rows:
                    lang = np.array([own_number[x] for x in batch.column("lang").to_pylist()])
                    total += expected_pieces(lattice, own_p, batch.column("word").to_pylist(), lang,
                                             batch.column("n").to_numpy().astype(float))
            lang, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(piece), pa.array(total[lang, piece])],
                                             ["lang", "piece", "n"])

        # Rounded, so that the order in which tasks are summed up cannot show in the model.
        sums = counts.mapInArrow(expect, "lang long, piece long, n double").groupBy("lang", "piece").agg(
            F.round(F.sum("n"), 6).alias("n")).toArrow()
        p = np.full(p.shape, SMOOTH)
        p[sums.column("lang").to_numpy(), sums.column("piece").to_numpy()] += sums.column("n").to_numpy()
        p /= p.sum(axis=1, keepdims=True)
    return langs, p


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], pieces: list[str]) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` from ``doc_id, text``: the language under which the
    whole text is most probable, and its share of the probability of all. A null text, one without
    letters, and any text under a model without languages is ``und`` with score 0."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((pieces, *model))
    narrow = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_pieces, langs, p = shared.value
        lattice, known = Lattice(own_pieces), {}
        scores, used = np.zeros((CACHED_WORDS, len(langs)), np.float32), 0
        for batch in batches:
            texts, best, share = batch.column("text").to_pylist(), [], []
            for begin in range(0, len(texts), 200):
                split = [words_of(t or "") for t in texts[begin:begin + 200]]
                if not langs:
                    best += ["und"] * len(split)
                    share += [0.0] * len(split)
                    continue
                new = list(set().union(*split).difference(known))
                if used + len(new) > CACHED_WORDS:
                    known, used, new = {}, 0, list(set().union(*split))
                    if len(new) > len(scores):
                        scores = np.zeros((len(new), len(langs)), np.float32)
                if new:
                    scores[used:used + len(new)] = word_scores(lattice, p, new)
                    known.update(zip(new, range(used, used + len(new))))
                    used += len(new)
                for words in split:
                    if not any(map(str.isalpha, words)) and not any(c.isalpha() for w in words for c in w):
                        best.append("und")
                        share.append(0.0)
                        continue
                    total = scores[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0, dtype=float)
                    top = int(total.argmax())
                    best.append(langs[top])
                    share.append(float(1 / np.exp(total - total[top]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(share, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    return narrow.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame, model_path: str, sample: int = SAMPLE) -> DataFrame:
    """Fits on the labelled part of ``docs`` (``doc_id, text, lang``; other columns are ignored) and
    identifies all of it. Every row gives one row, equal rows equal ones."""
    pieces = read_pieces(model_path)
    docs = docs.select("doc_id", "text", "lang")
    return identify(docs, fit(docs, pieces, sample), pieces)
