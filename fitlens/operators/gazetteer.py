"""Names of a table in texts, found by a trie over words.

A walk from each word of a text follows the trie of the names as far as it goes, so a text costs
its words plus what it finds, however many names there are and however long these are. A table of
bounded size is sent to the tasks as it is. A larger one is cut by the first two words of its
names; the places of the texts where such a name may begin go to the part with these names."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlens.functions.tags import TOKEN
from fitlens.operators.rows import small_side, stored

#: Bytes of names and labels whose trie a task holds, at some 30 times as many bytes of memory.
TRIE_BYTES = 16 << 20
#: Places of texts that are walked in one group, and cells of the table of possible first words.
GROUP, CELLS = 100_000, 1 << 22
_HITS = "_text long, begin int, words int, name string, label string"


def _trie(names: list[str], labels: list[str], max_words: int | None = None) -> dict:
    """Nested words; what ends at a node is a list of name, label and, if the name is more than its words
    joined by blanks, the characters in front of its first word."""
    token, root = regex.compile(TOKEN), {}
    for name, label in zip(names, labels):
        words = token.findall(name)
        if not words or len(words) > (max_words or len(words)):
            continue
        node = root
        for word in words:
            node = node.setdefault(word, {})
        node.setdefault("", []).append((name, label, -1 if name == " ".join(words) else token.search(name).start()))
    return root


def _walk(text: str, words: list[str], starts: list[int] | None, places: Iterator[int], trie: dict):
    """``place, words, name, label`` of all names that begin at the places; names of more than words must
    stand there as they are written."""
    token = regex.compile(TOKEN)
    for i in places:
        node, j = trie.get(words[i]), i
        while node is not None:
            for name, label, before in node.get("", ()):
                if before >= 0:
                    if starts is None:
                        starts = [m.start() for m in token.finditer(text)]
                    if starts[i] < before or not text.startswith(name, starts[i] - before):
                        continue
                yield i, j + 1 - i, name, label
            j += 1
            node = node.get(words[j]) if j < len(words) else None


def longest_first(hits: list[tuple]) -> Iterator[tuple]:
    """Of hits ``(place, words, ...)`` those that stay when a text is read from the left and each place is
    given to its longest name; names of the same words all stay."""
    end, now = 0, None
    for hit in sorted(hits, key=lambda h: (h[0], -h[1])):
        if hit[:2] == now or hit[0] >= end:
            now, end = hit[:2], hit[0] + hit[1]
            yield hit


def _entities(hits) -> dict[str, list[str]]:
    found: dict[str, set] = {}
    for *_, name, label in hits:
        found.setdefault(label, set()).add(name)
    return {label: sorted(found[label]) for label in sorted(found)}


def _with_one_trie(df: DataFrame, text: str, names: pa.Table, id_col: str, max_words: int | None, longest: bool) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast((names["name"].to_pylist(), names["label"].to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, trie = regex.compile(TOKEN), _trie(*sent.value, max_words)
        for batch in batches:
            rows, out = [], []
            for k, text in enumerate(batch.column("_text").to_pylist()):
                words = token.findall(text or "")
                firsts = trie.keys() & set(words)
                if not firsts:
                    continue
                hits = _walk(text, words, None, (i for i, w in enumerate(words) if w in firsts), trie)
                found = _entities(longest_first(list(hits)) if longest else hits)
                if found:
                    rows.append(k)
                    out.append(list(found.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(pa.array(rows, pa.int64())), pa.array(out, pa.map_(pa.string(), pa.list_(pa.string())))],
                [id_col, "entities"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, entities map<string,array<string>>")


def _key(first: str, second: str) -> int:
    return zlib.crc32(f"{first} {second}".encode())


def _with_parts(df: DataFrame, text: str, names: DataFrame, size: int, id_col: str, max_words: int | None, longest: bool) -> DataFrame:
    """For a table of any size. A part holds the names of some pairs of first words (or of one word only),
    so that a frequent first word is spread over parts; a part's places are dealt into bounded groups."""
    spark, shards = df.sparkSession, math.ceil(size / TRIE_BYTES)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = regex.compile(TOKEN)
        for batch in batches:
            found = [list(token.finditer(name)) for name in batch.column("name").to_pylist()]
            keep = [k for k, m in enumerate(found) if m and len(m) <= (max_words or len(m))]
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("name").take(take), batch.column("label").take(take),
                 pa.array([_key(found[k][0].group(), found[k][1].group() if len(found[k]) > 1 else "") for k in keep], pa.int64()),
                 pa.array([len(found[k]) for k in keep], pa.int32()), pa.array([found[k][0].start() for k in keep], pa.int32())],
                ["name", "label", "_key", "_words", "_before"])

    keys = stored(names.mapInArrow(keyed, "name string, label string, _key long, _words int, _before int"))
    widest = keys.agg(F.max("_words"), F.max("_before"), F.max(F.length("name"))).first()
    if widest[0] is None:
        return df.select(id_col, F.create_map().cast("map<string,array<string>>").alias("entities")).limit(0)
    most, before, chars = widest
    # Whether a name may begin with a pair of words: one bit for each cell of their hashes.
    cells = keys.select((F.col("_key") % CELLS).cast("int").alias("c")).distinct().toArrow()["c"].to_numpy()
    bits = np.zeros(CELLS, bool)
    bits[cells] = True
    may = spark.sparkContext.broadcast(np.packbits(bits))
    texts = stored(df.select(F.col(id_col), F.col(text).alias("_body")).withColumn("_text", F.monotonically_increasing_id()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, bits = regex.compile(TOKEN), np.unpackbits(may.value).view(bool)
        for batch in batches:
            for number, body in zip(batch.column("_text").to_pylist(), batch.column("_body").to_pylist()):
                found = list(token.finditer(body or ""))
                shard, begin, piece, offset = [], [], [], []
                for i, m in enumerate(found):
                    follower = found[i + 1].group() if i + 1 < len(found) else None
                    own = {_key(m.group(), w) for w in ("", follower) if w is not None}
                    own = {k % shards for k in own if bits[k % CELLS]}
                    if not own:
                        continue
                    # All that a name can cover here: its words, and as many characters as the longest has.
                    low = max(0, m.start() - before)
                    high = max(found[min(i + most, len(found)) - 1].end(), low + chars)
                    shard += sorted(own)
                    begin += [i] * len(own)
                    piece += [body[low:high]] * len(own)
                    offset += [m.start() - low] * len(own)
                for at in range(0, len(shard), 1000):
                    cut = slice(at, at + 1000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard[cut], pa.int32()), pa.array([number] * len(shard[cut]), pa.int64()), pa.array(begin[cut], pa.int32()),
                         pa.array(piece[cut], pa.string()), pa.array(offset[cut], pa.int32())], ["_shard", "_text", "begin", "piece", "offset"])

    asked = stored(texts.select("_text", "_body").mapInArrow(places, "_shard int, _text long, begin int, piece string, offset int"))
    salts = asked.groupBy("_shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).cast("int").alias("_salts"))
    asked = asked.join(small_side(salts), "_shard").withColumn("_salt", F.pmod(F.xxhash64("_text", "begin"), F.col("_salts")).cast("int"))
    held = keys.withColumn("_shard", (F.col("_key") % shards).cast("int")).join(small_side(salts), "_shard").select(
        "_shard", "name", "label", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))

    def walk(asked: pa.Table, names: pa.Table) -> pa.Table:
        token, trie = regex.compile(TOKEN), _trie(names["name"].to_pylist(), names["label"].to_pylist())
        out = []
        for number, begin, piece, offset in zip(*(asked[c].to_pylist() for c in ("_text", "begin", "piece", "offset"))):
            found = list(token.finditer(piece, offset))[:most]
            for _, n, name, label in _walk(piece, [m.group() for m in found], [m.start() for m in found], iter((0,)), trie):
                out.append((number, begin, n, name, label))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
        return pa.table({c: pa.array(v, k) for c, v, k in zip(("_text", "begin", "words", "name", "label"), columns, kinds)})

    # A name of one word is in another part than those of two words and more that begin with it.
    hits = asked.groupBy("_shard", "_salt").cogroup(held.groupBy("_shard", "_salt")).applyInArrow(walk, _HITS).distinct()
    if longest:
        hits = _longest_hits(hits)
    per_label = hits.groupBy("_text", "label").agg(F.array_sort(F.collect_set("name")).alias("names"))
    entities = per_label.groupBy("_text").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "names")))).alias("entities"))
    return texts.select("_text", id_col).join(entities, "_text").select(id_col, "entities")


def _longest_hits(hits: DataFrame) -> DataFrame:
    """The hits of every text that ``longest_first`` keeps, text by text in sorted streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, end, now = None, 0, None
        for batch in batches:
            keep = []
            for k, (number, begin, words) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_text", "begin", "words")))):
                if number != text:
                    text, end, now = number, 0, None
                if (begin, words) == now or begin >= end:
                    now, end = (begin, words), begin + words
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    return hits.repartition("_text").sortWithinPartitions("_text", "begin", F.desc("words")).mapInArrow(run, _HITS)


def tag_entities(df: DataFrame, text: str, gazetteer: DataFrame, id_col: str = "job_id",
                 max_words: int | None = None, longest: bool = False) -> DataFrame:
    """``id, entities`` for every row that holds a name of a gazetteer table (``name, label``): the names
    of each label, sorted.

    Names are cut into words as texts are, so a name of any length (up to ``max_words``, if given) and with
    any punctuation is found; one with punctuation must stand as it is written where its words do. All
    names are found, also within others, or, with ``longest``, the longest from the left, no two of
    which overlap. Null names and labels, names without words and null texts give nothing.

    A table of up to ``TRIE_BYTES`` is read and sent to the tasks, and no row leaves its partition; for
    a larger one the places where its names may begin are shuffled. Both give the same rows."""
    names = gazetteer.select("name", "label").filter("name is not null and label is not null").distinct()
    size = names.agg(F.sum(F.octet_length("name") + F.octet_length("label"))).first()[0] or 0
    if size <= TRIE_BYTES:
        return _with_one_trie(df, text, names.toArrow(), id_col, max_words, longest)
    return _with_parts(df, text, names, size, id_col, max_words, longest)
