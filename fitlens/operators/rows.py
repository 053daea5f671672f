"""One row per array element, and small join sides."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlens.session import ensure_checkpoint_dir


def each_item(df: DataFrame, array: Column | str, keep, item: str = "item", pos: str = "pos") -> DataFrame:
    """``keep`` columns, the element and its position from 0; no row for an empty array.

    Same rows as ``posexplode``. For that the optimizer would add a filter on the array's
    size, which computes an array expression (a parse, a model call) a second time and even
    below a repartition. The outer form does not, and its padding row is dropped after."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return rows.filter(F.col(pos).isNotNull())


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """The frame with a broadcast hint if it has at most ``max_rows`` rows, else unchanged.

    For a join on a key that few values share among most rows: shuffling on it would send
    those rows to few tasks. The count stops at the bound and reads no other column."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def stored(df: DataFrame) -> DataFrame:
    """The frame computed once and kept in the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, folders: list[str] | None = None) -> DataFrame:
    """As ``stored``, but as Parquet: for wide rows of which later steps read some columns only. ``folders`` gets
    the folder, for ``dropped``."""
    path = appended(df)
    if folders is not None:
        folders.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def appended(df: DataFrame, path: str | None = None) -> str:
    """The folder of Parquet files, a new one or ``path``, that the rows were added to."""
    path = path or f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.mode("append").parquet(path)
    return path


def dropped(spark: SparkSession, folders: list[str]) -> None:
    """Deletes the folders of written frames that nothing reads any more."""
    while folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of frames that are no longer held: it does so when the driver's JVM
    collects these, which a driver with little to do may not get to before the disk is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
