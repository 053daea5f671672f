"""Keep-first deduplication and keyed appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitlens.lexicon import NATURAL_KEY


def folded(key: Sequence[str]) -> list[Column]:
    """Case- and blank-insensitive form of string key columns."""
    return [F.lower(F.trim(F.col(k))) for k in key]


def keep_first(df: DataFrame, order: Sequence[Column | str], key: Sequence[Column | str] = NATURAL_KEY) -> DataFrame:
    """The first row of every key by ``order``.

    Written as ``row_number() = 1``: the planner adds a group limit in front of the shuffle,
    so every task sends at most one row per key and a hot key cannot pile up."""
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def keep_first_text(df: DataFrame, text: str, order: str) -> DataFrame:
    """The row with the smallest ``order`` for each distinct text, without sorting or shuffling
    texts: they are compared by a 256-bit hash, and tasks sum up their rows before the shuffle.
    Null is a text of its own."""
    rest = F.struct(order, *[c for c in df.columns if c not in (text, order)])
    kept = df.groupBy(F.sha2(F.col(text), 256).alias("_hash")).agg(F.min_by(rest, order).alias("_row"))
    return kept.select("_row.*")


def only_new(incoming: DataFrame, existing: DataFrame, key: Sequence[str] = NATURAL_KEY) -> DataFrame:
    """Incoming rows whose key the existing table lacks. Only key columns of the existing
    table are read. Null keys never count as known."""
    return incoming.join(existing.select(*key), list(key), "left_anti")


def posting_id(key: Sequence[str] = NATURAL_KEY) -> Column:
    """Replay-safe identifier of a posting: a 128-bit hash of its natural key, wide enough that
    no two keys of a very large table meet. A null differs from an empty text."""
    return F.md5(F.to_json(F.struct(*key)))
