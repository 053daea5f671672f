"""Tagging against lexicons that are tables, and the hook for a model of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitlens.functions.tags import tokens
from fitlens.operators.rows import each_item


def tag_verbs(df: DataFrame, text: str, verbs: DataFrame, id_col: str = "job_id") -> DataFrame:
    """``id, action_verbs`` for every row that holds a form of a verb table (``form, lemma``): the
    lemmas, sorted. A text sends each of its words once."""
    forms = verbs.select(F.lower("form").alias("_form"), "lemma").distinct()
    words = F.array_distinct(F.transform(tokens(text), F.lower))
    found = each_item(df.select(id_col, words.alias("_words")), "_words", [id_col], "_form").join(forms, "_form")
    return found.groupBy(id_col).agg(F.array_sort(F.collect_set("lemma")).alias("action_verbs"))


def tag_with(df: DataFrame, text: str, load: Callable[[], Callable[[pd.Series], pd.DataFrame]]) -> DataFrame:
    """Add ``entities`` and ``action_verbs`` from a tagger of the caller's.

    ``load()`` runs once per task and returns a function from a series of texts to a frame
    with the columns ``entities`` (dict label to names) and ``action_verbs`` (list): one
    pass over the text for both."""
    names = T.ArrayType(T.StringType())
    schema = T.StructType([*df.schema.fields, T.StructField("entities", T.MapType(T.StringType(), names)),
                           T.StructField("action_verbs", names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = load()
        for batch in batches:
            tags = tagger(batch[text])
            yield batch.assign(entities=tags["entities"].to_numpy(), action_verbs=tags["action_verbs"].to_numpy())

    return df.mapInPandas(run, schema)
