"""Tables in parts that change together.

A table is cut into parts: by a value such as a profile version, or by buckets of a key. What is written
goes to a folder of its own, which never changes. A manifest names the folders that hold each part of
each table at present, and writing the next manifest is the one step by which readers see a change:
until then they find all tables as they were, also if the writer fails half-way. An addition leaves the
folders of a part in place and names one more; a replacement names new ones for its parts only."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitlens.operators.rows import stored

_ENTRIES = "kind string, `table` string, part string, snapshot string, buckets int"
#: Rows of a bucket that a new table is laid out for, and the fewest and the most buckets.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 500_000, 8, 1 << 16
#: Folders of a part from which ``compact`` makes one.
MOST_FOLDERS = 16


@dataclass(frozen=True)
class Layout:
    """Schema of a table, and the column whose values, or whose buckets, are its parts."""

    schema: str
    column: str
    bucketed: bool = False


@dataclass
class Change:
    """Rows to add to a table, or to put in place of all rows of ``parts`` (a frame with the layout's
    column, or with ``part``), or of the ``whole`` table, then in ``buckets`` if that is given. Parts that
    get no row become empty."""

    rows: DataFrame | None = None
    parts: DataFrame | None = None
    whole: bool = False
    buckets: int | None = None


class Snapshots:
    """The tables of one root folder. Writers must take turns: of two that start from the same manifest
    the second fails and changes nothing."""

    def __init__(self, spark: SparkSession, root: str, layouts: Mapping[str, Layout]):
        self.spark, self.root, self.layouts = spark, root.rstrip("/"), dict(layouts)

    def _manifests(self) -> list[str]:
        """Numbers of the manifests, in order; a listing without a read."""
        try:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.root}/_manifests").select("path")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        number = F.regexp_extract("path", r"/_manifests/([0-9]+)/[^/]*$", 1)
        return sorted(r[0] for r in files.select(number.alias("n")).distinct().collect())

    def manifest(self, number: str | None = None) -> DataFrame:
        """``kind, table, part, snapshot, buckets``: a row per table, and one per part and folder of it."""
        number = number or (self._manifests() or [None])[-1]
        if number is None:
            return self.spark.createDataFrame([], _ENTRIES)
        return self.spark.read.schema(_ENTRIES).json(f"{self.root}/_manifests/{number}").filter("kind <> 'manifest'")

    def exists(self, table: str) -> bool:
        return not self.manifest().filter((F.col("kind") == "table") & (F.col("table") == table)).isEmpty()

    def _buckets(self, manifest: DataFrame, table: str) -> int | None:
        row = manifest.filter((F.col("kind") == "table") & (F.col("table") == table)).select("buckets").first()
        return row[0] if row else None

    def _part(self, table: str, buckets: int | None) -> Column:
        column = F.col(self.layouts[table].column)
        if not self.layouts[table].bucketed:
            return column.cast("string")
        return F.lpad(F.pmod(F.xxhash64(column), F.lit(buckets)).cast("string"), 5, "0")

    def parts_of(self, table: str, keys: DataFrame) -> DataFrame:
        """The parts in which rows with the keys (the layout's column) are, or would be."""
        return keys.select(self._part(table, self._buckets(self.manifest(), table)).alias("part")).distinct()

    def read(self, table: str, parts: DataFrame | None = None, manifest: DataFrame | None = None) -> DataFrame:
        """The rows of a table, or of some parts (``part``) of it: only folders named by the manifest are
        read. A table never written raises ``FileNotFoundError``."""
        manifest = self.manifest() if manifest is None else manifest
        entries = manifest.filter(F.col("table") == table)
        if entries.filter("kind = 'table'").isEmpty():
            raise FileNotFoundError(f"{self.root}/{table}")
        live = entries.filter("kind = 'part'").select("part", "snapshot")
        if parts is not None:
            live = live.join(parts.select(F.col("part").alias("_p")), F.col("part").eqNullSafe(F.col("_p")), "left_semi")
        # Folders are named one by one, so that none of the others is listed or read.
        folders = sorted(r[0] for r in live.select("snapshot").distinct().collect())
        schema = T.StructType.fromDDL(self.layouts[table].schema)
        if not folders:
            return self.spark.createDataFrame([], schema)
        stored_as = T.StructType([*schema.fields, T.StructField("snapshot", T.StringType()), T.StructField("part", T.StringType())])
        base = f"{self.root}/{table}"
        rows = self.spark.read.schema(stored_as).option("basePath", base).parquet(*[f"{base}/snapshot={f}" for f in folders])
        if parts is not None:
            wanted = [r[0] for r in live.select("part").distinct().limit(MOST_BUCKETS + 1).collect()]
            if len(wanted) <= MOST_BUCKETS and None not in wanted:
                rows = rows.filter(F.col("part").isin(wanted))
        live = live.select(F.col("part").alias("_p"), F.col("snapshot").alias("_s"))
        return rows.join(live, (F.col("snapshot") == F.col("_s")) & F.col("part").eqNullSafe(F.col("_p")), "left_semi").select(*schema.names)

    def commit(self, changes: Mapping[str, Change]) -> None:
        """Make all changes at once. Rows are written first, a folder per table; then the manifest."""
        if not changes:
            return
        numbers = self._manifests()
        number = f"{int(numbers[-1] if numbers else 0) + 1:012d}"
        old = stored(self.manifest(numbers[-1])) if numbers else self.manifest()
        kept, added = old, [("manifest", None, None, number, None)]
        for table, change in changes.items():
            rows, buckets = change.rows, change.buckets or self._buckets(old, table)
            if self.layouts[table].bucketed and buckets is None and rows is not None:
                rows = stored(rows)
                buckets = buckets_for(rows.count())
            gone = (F.col("table") == table) & ((F.col("kind") == "table") | F.lit(change.whole))
            kept = kept.filter(~gone)
            added.append(("table", table, None, None, buckets))
            if change.parts is not None and not change.whole:
                named = change.parts if "part" in change.parts.columns else change.parts.select(self._part(table, buckets).alias("part"))
                named = named.select(F.col("part").alias("_p")).distinct()
                kept = kept.join(named, (F.col("table") == table) & (F.col("kind") == "part") & F.col("part").eqNullSafe(F.col("_p")), "left_anti")
            if rows is not None:
                added += [("part", table, part, snapshot, None) for part, snapshot in self._written(table, rows, buckets, number)]
        manifest = kept.unionByName(self.spark.createDataFrame(added, _ENTRIES)).coalesce(1)
        manifest.write.mode("errorifexists").json(f"{self.root}/_manifests/{number}")

    def _written(self, table: str, rows: DataFrame, buckets: int | None, number: str) -> list[tuple]:
        """Write rows to a new folder; its parts."""
        schema = T.StructType.fromDDL(self.layouts[table].schema)
        snapshot = f"{number}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.root}/{table}/snapshot={snapshot}"
        placed = rows.select(*schema.names, self._part(table, buckets).alias("part"))
        if buckets is not None:
            placed = placed.repartition("part")
        placed.write.option("partitionOverwriteMode", "static").partitionBy("part").parquet(folder)
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path")
        if files.isEmpty():
            return []
        written = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.StringType())])).parquet(folder)
        return [(r[0], snapshot) for r in written.select("part").distinct().collect()]

    def upsert(self, table: str, rows: DataFrame, gone: DataFrame, key: Sequence[str]) -> None:
        """Add rows and take out those with the keys of ``gone``, in one step. ``key`` has the layout's column.
        Only parts that hold such a key are written again; to others rows are added."""
        manifest = stored(self.manifest())
        buckets = self._buckets(manifest, table)
        gone = stored(gone.select(*key).distinct())
        if (self.layouts[table].bucketed and buckets is None) or gone.isEmpty():
            self.commit({table: Change(rows)})
            return
        touched = stored(gone.select(self._part(table, buckets).alias("part")).distinct())
        kept = self.read(table, touched, manifest).join(gone, list(key), "left_anti")
        self.commit({table: Change(kept.unionByName(rows.select(*kept.columns)), touched)})

    def compact(self, table: str, most_folders: int = MOST_FOLDERS) -> None:
        """Put the folders of a part into one where there are more than ``most_folders``."""
        manifest = stored(self.manifest())
        crowded = stored(manifest.filter((F.col("kind") == "part") & (F.col("table") == table)).groupBy("part").agg(
            F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_folders).select("part"))
        if not crowded.isEmpty():
            self.commit({table: Change(self.read(table, crowded, manifest), crowded)})

    def rebucket(self, table: str, buckets: int) -> None:
        """Lay a bucketed table out anew, as it has grown."""
        self.commit({table: Change(stored(self.read(table)), whole=True, buckets=buckets)})

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that none of the last ``keep`` manifests names, and the older manifests. Returns
        how many folders went. No writer may be at work, and no reader of an older manifest."""
        numbers = self._manifests()
        named = {(r[0], r[1]) for n in numbers[-keep:] for r in self.manifest(n).filter("kind = 'part'").select("table", "snapshot").distinct().collect()}
        jvm = self.spark._jvm
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        files = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = 0
        for table in self.layouts:
            base = path(f"{self.root}/{table}")
            for status in files.listStatus(base) if files.exists(base) else ():
                name = status.getPath().getName()
                if name.startswith("snapshot=") and (table, name.removeprefix("snapshot=")) not in named:
                    gone += bool(files.delete(status.getPath(), True))
        for number in numbers[:-keep]:
            files.delete(path(f"{self.root}/_manifests/{number}"), True)
        return gone


def buckets_for(rows: int) -> int:
    """Number of buckets of a new table: a power of two."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << math.ceil(math.log2(max(1, rows / BUCKET_ROWS)))))
