"""JSON lists of any size, read by many tasks.

A list in one file has no lines to cut it at, so the file is read in byte ranges whose records end
at a closing brace, wherever that brace stands. A first pass finds how each range changes the
state of a scanner: whether it is inside a string, and how deep. Put together, these tell the
state at the start of every range. With it a second pass cuts the elements; an element that
goes over the end of a range is put together again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitlens.functions.text import one_value
from fitlens.operators.rows import stored

#: Characters that may stand around a document.
_AROUND = " \t\r\n\ufeff"


def _structure(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every byte, whether it is a quote that begins or ends a string, and how it changes the depth
    if it stands outside of strings."""
    b = np.frombuffer(data, np.uint8)
    place = np.arange(len(b))
    plain = np.maximum.accumulate(np.where(b != ord("\\"), place, -1))
    run = np.concatenate(([0], place[:-1] - plain[:-1]))
    quote = (b == ord('"')) & (run % 2 == 0)
    depth = ((b == ord("{")) | (b == ord("["))).astype(np.int64) - ((b == ord("}")) | (b == ord("]")))
    return quote, depth


def _ranges(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, bytes, bool]]:
    """Path, start and ``columns``, bytes, and whether a range begins, in the order of the files. A record
    lacks the brace that ended it; one is put behind the last record of a file too."""
    before = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("path", "start", *columns))))
        values = batch.column("value").cast(pa.binary())
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k][:2] != keys[k - 1][:2]), len(keys)]
        for begin, end in zip(cuts, cuts[1:]):
            if begin < end:
                data = b"".join(v + b"}" for v in values.slice(begin, end - begin).to_pylist())
                yield keys[begin], data, keys[begin][:2] != before
                before = keys[begin][:2]


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds.values())], list(kinds))


_SUMMARY = {"path": pa.string(), "start": pa.int64(), "size": pa.int64(), "bytes": pa.int64(), "first": pa.string(),
            "quotes": pa.int64(), "depth_outside": pa.int64(), "depth_inside": pa.int64()}


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: bytes, the first character that is not blank, quotes modulo two, and the change of depth
    if the range begins outside and inside of a string."""
    rows: list[list] = []
    for (path, start, size), data, new in _ranges(batches, "size"):
        if new:
            rows.append([path, start, size, 0, None, 0, 0, 0])
        row = rows[-1]
        quote, depth = _structure(data)
        inside = np.concatenate(([0], np.cumsum(quote)[:-1])) % 2 == 1
        row[3] += len(data)
        row[4] = row[4] or data.decode("utf-8", "replace").lstrip(_AROUND)[:1] or None
        # Quotes before these bytes turn the two cases round.
        out, in_ = int(depth[~inside].sum()), int(depth[inside].sum())
        row[6], row[7] = (row[6] + out, row[7] + in_) if row[5] == 0 else (row[6] + in_, row[7] + out)
        row[5] = (row[5] + int(quote.sum())) % 2
    yield _batch(rows, _SUMMARY)


class _Cutter:
    """Cuts the elements of one range."""

    def __init__(self, inside: int, depth: int, is_list: bool, length: int):
        self.inside, self.depth, self.is_list, self.left = inside, depth, is_list, length
        self.open, self.at, self.opened, self.closed, self.bad = b"", 0, 0, 0, False

    def cut(self, data: bytes) -> list[tuple[int, bytes]]:
        """Number within the range, from 0, and text of each element that ends in ``data``."""
        data = data[:self.left]
        self.left -= len(data)
        if not self.is_list or not data:
            self.open += data
            return []
        quote, change = _structure(data)
        inside = (self.inside + np.concatenate(([0], np.cumsum(quote)[:-1]))) % 2 == 1
        change = np.where(inside, 0, change)
        after = self.depth + np.cumsum(change)
        self.inside, self.depth = (self.inside + int(quote.sum())) % 2, int(after[-1])
        b = np.frombuffer(data, np.uint8)
        comma = (b == ord(",")) & ~inside & (after == 1)
        opens, closes = (change == 1) & (after == 1), (change == -1) & (after == 0)
        # At the top there may be one list.
        self.opened, self.closed = self.opened + int(opens.sum()), self.closed + int(closes.sum())
        self.bad |= bool((b[opens] != ord("[")).any() or (b[closes] != ord("]")).any() or (after < 0).any())
        out, begin = [], 0
        for k in np.flatnonzero(comma | opens | closes).tolist():
            text, self.open, begin = self.open + data[begin:k], b"", k + 1
            if opens[k]:
                self.bad |= bool(text.decode("utf-8", "replace").strip(_AROUND))
            else:
                out.append((self.at, text))
                self.at += 1
        self.open += data[begin:]
        return out


_FRAGMENT = {"path": pa.string(), "start": pa.int64(), "nth": pa.int64(), "text": pa.binary(), "ends": pa.bool_(),
             "opened": pa.int64(), "closed": pa.int64(), "bad": pa.bool_()}


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements that end in a range, and one row for what is left at its end, with the number of ended
    ones. Of an element that began in an earlier range it is the rest."""
    held: list[tuple] = []
    cutter, key = None, None

    def end_range():
        if cutter is not None:
            held.append((*key, cutter.at, cutter.open, False, cutter.opened, cutter.closed, cutter.bad))

    for (path, start, inside, depth, kind, length), data, new in _ranges(batches, "inside", "depth", "kind", "length"):
        if new:
            end_range()
            cutter, key = _Cutter(inside, depth, kind == "[", length), (path, start)
        held.extend((*key, nth, text, True, 0, 0, False) for nth, text in cutter.cut(data))
        if sum(len(h[3]) for h in held) > 1 << 22:
            yield _batch(held, _FRAGMENT)
            held.clear()
    end_range()
    yield _batch(held, _FRAGMENT)


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    names = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{name} {names[kind]}" for name, kind in kinds.items())


def read_split(spark: SparkSession, path: str, larger_than: int) -> DataFrame:
    """``file, pos, doc, reason`` of the ``*.json`` files of a folder with more than ``larger_than`` bytes: the
    rows that ``postings.parse_postings`` gives for their texts, whatever the ranges are. A range is as
    long as Spark's scans cut files (``spark.sql.files.maxPartitionBytes``). Records end at braces, so a
    list without any is one record. The files are read twice; one row a range is sent to the tasks."""
    pieces = spark.read.option("lineSep", "}").option("pathGlobFilter", "*.json").text(path).filter(
        F.col("_metadata.file_size") > larger_than).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    ranges = stored(pieces.select("path", "start", "size", "value").mapInArrow(_summaries, _ddl(_SUMMARY)))
    of_file = Window.partitionBy("path")
    before = of_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = (
        ranges.withColumn("inside", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)))
        .withColumn("change", F.when(F.col("inside") == 0, F.col("depth_outside")).otherwise(F.col("depth_inside")))
        .withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
        .withColumn("kind", F.first("first").over(of_file.orderBy("start")))
        # A file that does not end in a brace has one byte less than its records and braces; Spark
        # leaves out a byte order mark of three bytes.
        .withColumn("over", (F.lead("start").over(of_file.orderBy("start")).isNull() & (F.sum("bytes").over(of_file) - F.col("size")).isin(1, -2)).cast("long"))
        .select("path", "start", "inside", "depth", "kind", (F.col("bytes") - F.col("over")).alias("length")))
    # The state must reach the pieces where they are read: moved by a shuffle they would lose their order.
    placed = pieces.select("path", "start", "value").join(F.broadcast(stored(states)), ["path", "start"])
    found = stored(placed.mapInArrow(_fragments, _ddl(_FRAGMENT)))

    ends = found.filter("not ends")
    shift = ends.withColumn("shift", F.coalesce(F.sum("nth").over(before), F.lit(0))).select("path", "start", "shift")
    numbered = found.join(shift, ["path", "start"]).withColumn("pos", F.col("nth") + F.col("shift"))
    cut = numbered.filter("not ends or nth = 0").groupBy("path", "pos").agg(
        F.array_sort(F.collect_list(F.struct("start", "text"))).alias("t"), F.max("ends").alias("ends"))
    # Joined as hexadecimal digits, as a range may end inside a character.
    whole = cut.select("path", "pos", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["text"])), "")).alias("text"), "ends")
    elements = numbered.filter("ends and nth > 0").select("path", "pos", "text", "ends").unionByName(whole)
    text = F.trim(F.decode("text", "utf-8"), F.lit(_AROUND))
    elements = stored(elements.select("path", "pos", "ends", text.alias("text"), F.when(one_value(text), F.try_parse_json(text)).alias("doc")))

    kinds = states.select("path", "kind").distinct()
    lists = elements.filter("ends").groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc").isNull()).alias("unread"), F.max(F.col("text") == "").alias("blank"))
    behind = elements.filter("not ends").groupBy("path").agg(F.max(F.col("text") != "").alias("more"), F.max(F.col("doc").isNull()).alias("no_object"))
    balance = ends.groupBy("path").agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"), F.max("bad").alias("bad"))
    checked = kinds.join(balance, "path").join(lists, "path", "left").join(behind, "path", "left")
    empty = F.coalesce((F.col("n") == 1) & F.col("blank"), F.lit(False))
    good_list = (F.col("kind") == "[") & (F.col("opened") == 1) & (F.col("closed") == 1) & ~F.col("bad") & ~F.col("more") & (
        empty | (F.coalesce("unread", F.lit(0)) == 0))
    good_object = (F.col("kind") == "{") & ~F.col("no_object")
    verdict = checked.select("path", "kind", (good_list | good_object).alias("good"), (good_list & empty).alias("empty"))
    name = F.regexp_extract("path", "[^/]*$", 0).alias("file")
    good = elements.join(verdict.filter("good and not empty"), "path").filter((F.col("kind") == "{") | F.col("ends"))
    is_object = F.schema_of_variant("doc").startswith("OBJECT")
    rows = good.select(name, F.col("pos").cast("int").alias("pos"), "doc", F.when(~is_object, "not_an_object").alias("reason"))
    broken = verdict.filter("not good").select(
        name, F.lit(0).alias("pos"), F.lit(None).cast("variant").alias("doc"), F.lit("invalid_file").alias("reason"))
    return rows.unionByName(broken)
