"""Stage tables as Parquet folders under one root."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlens import schemas
from fitlens.operators.dedup import only_new
from fitlens.sources.snapshots import Change, Layout, Snapshots

#: Tables whose parts are replaced, several tables together.
LAYOUTS = {"rankings": Layout(schemas.RANKINGS, "profile_version"),
           "granular_scores": Layout(schemas.GRANULAR_SCORES, "profile_version"),
           "job_embeddings": Layout(schemas.JOB_EMBEDDINGS, "job_id", bucketed=True)}
DERIVED = ("clean_postings", "job_embeddings", "profile_embeddings", "rankings", "granular_scores")


SMALL_BYTES_PER_CORE = 4 << 20
BYTES_PER_SLICE = 128 << 10


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a plain scan is small and has fewer splits than cores.

    A small file in one row group would otherwise keep one core busy. A scan with enough
    splits, or one of more than a few MB per core, is left alone: no large input is ever
    shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    size = int(str(execution.optimizedPlan().stats().sizeInBytes()))
    if size > cores * SMALL_BYTES_PER_CORE or execution.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(max(1, min(cores, size // BYTES_PER_SLICE)))


class Store:
    """The stage tables of one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.snapshots = Snapshots(spark, root, LAYOUTS)

    def path(self, name: str) -> str:
        if name not in schemas.TABLES:
            raise KeyError(name)
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        """A stage table; a table never written raises ``FileNotFoundError``."""
        if name in LAYOUTS:
            return self.snapshots.read(name)
        try:
            return self.spark.read.schema(schemas.TABLES[name]).parquet(self.path(name))
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(self.path(name)) from error
            raise

    def exists(self, name: str) -> bool:
        try:
            self.read(name)
        except FileNotFoundError:
            return False
        return True

    def read_or_empty(self, name: str) -> DataFrame:
        """A stage table, or an empty frame of its schema."""
        return self.read(name) if self.exists(name) else self.spark.createDataFrame([], schemas.TABLES[name])

    def write(self, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        if name in LAYOUTS:
            self.snapshots.commit({name: Change(df, whole=mode == "overwrite")})
            return
        columns = [f.name for f in self.spark.createDataFrame([], schemas.TABLES[name]).schema]
        df.select(*columns).write.mode(mode).parquet(self.path(name))

    def append_new(self, name: str, df: DataFrame, key) -> None:
        """Append the rows whose key is not there yet. Running it again adds nothing."""
        self.write(name, only_new(df, self.read_or_empty(name), key), "append")

    def replace_versions(self, frames: Mapping[str, DataFrame], versions: DataFrame) -> None:
        """Replace the rows of the given profile versions in several tables at once; other versions stay, and
        one without new rows keeps none. A failure on the way leaves all tables as they were."""
        versions = versions.select("profile_version").distinct()
        self.snapshots.commit({name: Change(df, versions) for name, df in frames.items()})

    def clear(self, names=DERIVED) -> dict[str, int]:
        """Empty tables by overwriting them, children before parents. Returns the rows each
        held. Raw postings are kept unless named."""
        removed = {name: self.read(name).count() for name in sorted(names, key=list(schemas.TABLES).index, reverse=True)
                   if self.exists(name)}
        self.snapshots.commit({name: Change(whole=True) for name in removed if name in LAYOUTS})
        for name in removed:
            if name not in LAYOUTS:
                (self.spark.createDataFrame([], schemas.TABLES[name]).write.mode("overwrite")
                 .option("partitionOverwriteMode", "static").parquet(self.path(name)))
        return removed

    def listing(self) -> DataFrame:
        """``table, present`` for every stage table."""
        rows = [(name, self.exists(name)) for name in schemas.TABLES]
        return self.spark.createDataFrame(rows, "`table` string, present boolean")

    def register(self) -> None:
        """Stage tables as temporary views, for SQL."""
        for name in schemas.TABLES:
            self.read_or_empty(name).createOrReplaceTempView(name)


def with_processed_flag(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Raw postings with ``is_processed``: whether the key is in the clean table. The flag is
    derived, so it cannot disagree with the data."""
    done = clean.select("job_id").distinct().withColumn("_done", F.lit(True))
    return raw.join(done, "job_id", "left").withColumn(
        "is_processed", F.coalesce("_done", F.lit(False))).drop("_done")


def unprocessed(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Raw postings without a clean row, newest first, ties by id; undated ones last."""
    return raw.join(clean.select("job_id"), "job_id", "left_anti").orderBy(F.desc_nulls_last("date_posted"), "job_id")


def sql(spark: SparkSession, query: str, params=None) -> DataFrame:
    """A SQL query with named (dict) or positional (list) parameters, as a frame."""
    return spark.sql(query, args=params) if params else spark.sql(query)
