"""Loading, written intermediate tables and small helpers that several operators share."""

from __future__ import annotations

import pickle
import uuid

from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlens.session import ensure_checkpoint_dir

#: White space between words, everywhere in this subpackage: space and TAB to CR.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back.

    For a result that several later steps read: it is computed once, its lineage ends, and a
    lost executor loses nothing, as the files lie in the folder that all executors share."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent(spark: SparkSession, value) -> Broadcast:
    """``value`` sent to the tasks with the code of its classes. A plain broadcast names a class by its
    module, which executors without this package cannot import."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast):
    """What was sent; to be built once per task."""
    return pickle.loads(shared.value)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, though the body uses it often."""
    return F.transform(F.array(value), body)[0]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
