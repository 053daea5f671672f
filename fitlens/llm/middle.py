"""Fill-in-middle: texts cut into prefix, middle and suffix and written in another order.

The cut is a pipeline of Arrow computations over a slice of a batch: texts become list arrays of
units, the lists are flattened with the row they come from, every unit gets its place in the
text and from that its role, the units of a role are filtered and put back into lists, and the
lists are joined to pieces. There is no loop over rows or units."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, those that stay plain, and of 100 others those written suffix first.
PLAIN, SPM = 10, 20
#: Bytes of text whose units are held at once. A longer text goes through in several pieces.
SLICE_BYTES = 1 << 20


def draws(doc_id: Column) -> list[Column]:
    """Four numbers below 2^32 that depend on the id alone: the first four groups of eight digits of
    the SHA-256 of ``1:`` and the id. A null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _modulo(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each starts."""
    texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def _units(data: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    """Lists of the code points of consecutive texts whose bytes start at ``starts``."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    offsets = np.append(first, len(data)).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data.tobytes()))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, starts).astype(np.int32)), flat)


def _pieces(units: pa.ListArray, before: pa.Array, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of every list. ``before`` counts the units of the same text in earlier
    lists; the middle begins at ``low`` and ends at ``high`` units."""
    parent = pc.list_parent_indices(units)
    flat = pc.list_flatten(units)
    start = pc.cast(units.offsets[:-1], pa.int64())
    ordinal = pc.add(pc.subtract(pa.array(np.arange(len(flat))), start.take(parent)), before.take(parent))
    role = pc.add(pc.cast(pc.greater_equal(ordinal, low.take(parent)), pa.int8()),
                  pc.cast(pc.greater_equal(ordinal, high.take(parent)), pa.int8()))
    out = []
    for k in range(3):
        own = pc.equal(role, pa.scalar(k, pa.int8()))
        counts = np.bincount(parent.filter(own).to_numpy(), minlength=len(units))
        ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        out.append(pc.binary_join(pa.ListArray.from_arrays(ends, flat.filter(own)), ""))
    return out


def cut(texts: pa.Array, low: pa.Array, high: pa.Array, slice_bytes: int = SLICE_BYTES) -> list[pa.Array]:
    """Prefix, middle and suffix of every text; none is null. Holds the units of about
    ``slice_bytes`` of text at once, however long a text is."""
    data, at = _flat(texts)
    # Slices end where a code point does: at most three bytes later than asked.
    edges = np.arange(0, len(data), slice_bytes)
    for _ in range(3):
        inside = edges < len(data)
        edges[inside] += (data[edges[inside]] & 0xC0) == 0x80
    edges = np.append(edges, len(data))
    parts: list[list[pa.Array]] = [[], [], []]
    rows, seen = [], np.zeros(len(texts), np.int64)
    for begin, end in zip(edges[:-1], edges[1:]):
        # The texts with bytes in the slice; empty ones have none and get their pieces below.
        own = np.flatnonzero((at[:-1] < end) & (at[1:] > begin) & (at[1:] > at[:-1]))
        if not len(own):
            continue
        starts = np.append(np.maximum(at[own], begin), end) - begin
        starts[-1] = min(end, at[own[-1] + 1]) - begin
        units = _units(data[begin:begin + starts[-1]], starts)
        take = pa.array(own)
        for part, piece in zip(parts, _pieces(units, pa.array(seen[own]), low.take(take), high.take(take))):
            part.append(piece)
        rows.append(own)
        seen[own] += pc.list_value_length(units).to_numpy()
    if not rows:
        return [pa.array([""] * len(texts), pa.string())] * 3
    # Pieces come in the order of their texts, so a text's pieces are neighbours.
    counts = np.bincount(np.concatenate(rows), minlength=len(texts))
    ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    return [pc.binary_join(pa.ListArray.from_arrays(ends, pa.concat_arrays(part)), "") for part in parts]


def _written(texts: pa.Array, h: list[pa.Array], plain: int, spm: int) -> list[pa.Array]:
    """``n, form, prefix_chars, middle_chars, output`` of texts without nulls."""
    n = pc.cast(pc.utf8_length(texts), pa.int64())
    ends = pc.add(n, 1)
    x, y = _modulo(h[0], ends), _modulo(h[1], ends)
    low, high = pc.min_element_wise(x, y), pc.max_element_wise(x, y)
    marked = pc.or_(pc.or_(pc.match_substring(texts, PREFIX), pc.match_substring(texts, SUFFIX)), pc.match_substring(texts, MIDDLE))
    drawn = pc.greater_equal(_modulo(h[2], pa.scalar(100, pa.int64())), pa.scalar(100 - plain, pa.int64()))
    as_is = pc.or_(pc.or_(pc.equal(n, 0), marked), drawn)
    suffix_first = pc.less(_modulo(h[3], pa.scalar(100, pa.int64())), pa.scalar(spm, pa.int64()))
    form = pc.if_else(as_is, "plain", pc.if_else(suffix_first, "spm", "psm"))
    prefix, middle, suffix = cut(texts, low, high)
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm_text = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    output = pc.if_else(as_is, texts, pc.if_else(suffix_first, spm_text, psm))
    none = pa.scalar(None, pa.int64())
    return [n, form, pc.if_else(as_is, none, low), pc.if_else(as_is, none, pc.subtract(high, low)), output]


def fill_in_middle(docs: DataFrame, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs`` (``doc_id,
    text``; other columns are ignored).

    ``n`` counts code points. Of 100 texts ``plain`` stay as they are, and so do empty ones, null ones
    (as empty texts) and those that hold a marker; their lengths are null. Of 100 others ``spm`` have
    the suffix first. What is drawn depends on the id alone: equal rows give equal rows, rows
    without id draw alike, and reruns agree. No row leaves its partition. A slice of a batch
    takes some 60 bytes of memory a code point, a batch a few times its texts."""
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                         *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id")))])
    kind = narrow.schema["doc_id"].dataType.simpleString()
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
            cuts = np.flatnonzero(np.diff(size // (8 * SLICE_BYTES))) + 1
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(begin, end - begin)
                columns = _written(part.column("text"), [part.column(f"h{k}") for k in range(4)], plain, spm)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *names])

    return narrow.mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text with a marker stays plain, and no marker can arise
    where a piece meets one, so every marker in another output stands where it was put."""
    head = F.substring(F.split_part(output, F.lit(SUFFIX), F.lit(1)), len(PREFIX) + 1, 2 ** 31 - 1)
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    tail = F.split_part(F.split_part(output, F.lit(SUFFIX), F.lit(2)), F.lit(MIDDLE), F.lit(1))
    spm_tail = F.split_part(F.split_part(output, F.lit(SUFFIX), F.lit(2)), F.lit(PREFIX), F.lit(1))
    spm_head = F.split_part(F.split_part(output, F.lit(PREFIX), F.lit(2)), F.lit(MIDDLE), F.lit(1))
    return F.when(form == "psm", F.concat(head, middle, tail)).when(form == "spm", F.concat(spm_head, middle, spm_tail)).otherwise(output)


#: The digest of the whole table in SQL.
SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), cuts AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), pieces AS (
  SELECT *, least(x, y) AS lo, greatest(x, y) AS hi, substr(text, 1, least(x, y)) AS prefix,
    substr(text, least(x, y) + 1, greatest(x, y) - least(x, y)) AS middle, substr(text, greatest(x, y) + 1) AS suffix
  FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""
