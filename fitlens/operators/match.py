"""Every posting vector against every profile vector, reduced to the best few per posting.

The profile side is one document's rows, some dozens. It is read with a row limit one
above ``MAX_PROFILE_ROWS``; below the bound it is packed into a matrix that each task
holds, and one matrix product per Arrow batch gives all similarities of the batch. The
best rows are picked in the same step, so nothing is shuffled and no pair is ever
written out. A larger profile is laid out in cells, of which a posting meets those that can
hold its best rows: same result, and only the best rows of each cell leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitlens.operators.cells import best_rows, similarities, unit_rows
from fitlens.operators.rows import each_item, released, stored, written

OVERALL = "overall_resume"
MAX_PROFILE_ROWS = 4096
_CELLS = 500_000
_OUTPUT_BYTES = 4 << 20
_META = ("section", "subsection", "content_type", "text")
_META_DDL = ",".join(f"{c}:string" for c in _META)
_MATCH_DDL = f"struct<ordinal:int,{_META_DDL},similarity:double>"


@dataclass
class _Profile:
    """A bounded set of profile rows in a form cheap to ship to tasks."""

    rows: pa.Table
    top_n: int
    per_section: Mapping[str, int] | None
    dim: int = 0

    def __post_init__(self):
        order = np.lexsort((np.asarray(self.rows["ordinal"]),
                            np.asarray(self.rows["profile_version"].to_pylist(), dtype=str)))
        rows = self.rows.take(pa.array(order)).combine_chunks()
        self.unit = unit_rows(rows["embedding"], self.dim) if self.dim else np.zeros((len(order), 0))
        meta = {"ordinal": rows["ordinal"].cast(pa.int32()).combine_chunks()}
        for name in _META:
            column = rows[name].combine_chunks() if name in rows.column_names else None
            meta[name] = column.cast(pa.string()) if column is not None else pa.nulls(len(order), pa.string())
        self.meta = meta
        sections = np.asarray(meta["section"].to_pylist(), dtype=object)
        versions = np.asarray(rows["profile_version"].to_pylist(), dtype=object)
        self.groups = []
        for version in dict.fromkeys(versions):
            of_version = versions == version
            if self.per_section is None:
                picks = [(np.flatnonzero(of_version), self.top_n)]
            else:
                picks = [(np.flatnonzero(of_version & (sections == s)), n) for s, n in self.per_section.items()]
            overall = np.flatnonzero(of_version & (sections == OVERALL))
            self.groups.append((version, overall[:1], [(c, n) for c, n in picks if len(c) and n > 0]))
        self.rows = None

    def best(self, vectors: pa.Array):
        """Per chunk of rows and profile version: overall similarities (or None) and the
        picked profile rows with their similarities, best first."""
        # A profile without any vector is similar to nothing.
        jobs = unit_rows(vectors, self.dim) if self.dim else np.zeros((len(vectors), 0))
        present = np.asarray(vectors.is_valid())
        step = max(1, _CELLS // max(len(self.unit), 1))
        for at in range(0, len(jobs), step):
            sims = similarities(jobs[at:at + step], self.unit)
            for version, overall, picks in self.groups:
                chosen = []
                for columns, n in picks:
                    order = np.argsort(-sims[:, columns], axis=1, kind="stable")[:, :n]
                    chosen.append(columns[order])
                picked = np.concatenate(chosen, axis=1) if chosen else np.zeros((len(sims), 0), dtype=int)
                whole = sims[:, overall[0]] if len(overall) else None
                yield (version, at, present[at:at + step], whole, picked,
                       np.take_along_axis(sims, picked, axis=1))

    def bytes_per_row(self) -> int:
        """About the most bytes that the matches of one posting take."""
        texts = [sum(len(v) for v in row if v) for row in zip(*(self.meta[m].to_pylist() for m in _META))]
        picked = sum(min(n, len(c)) for *_, picks in self.groups for c, n in picks)
        return (picked + len(self.groups)) * (32 + 4 * max(texts, default=0))

    def match_struct(self, picked: np.ndarray, sims: np.ndarray) -> pa.StructArray:
        flat = pa.array(picked.reshape(-1))
        arrays = [self.meta["ordinal"].take(flat), *[self.meta[m].take(flat) for m in _META],
                  pa.array(sims.reshape(-1))]
        return pa.StructArray.from_arrays(arrays, names=["ordinal", *_META, "similarity"])


def _bounded(profile: DataFrame, limit: int) -> pa.Table | None:
    """The profile rows when there are at most ``limit`` of them, otherwise None."""
    keep = [c for c in ("profile_version", "ordinal", *_META, "embedding") if c in profile.columns]
    table = profile.select(*keep).limit(limit + 1).toArrow()
    return table if table.num_rows <= limit else None


def match_profile(jobs: DataFrame, profile: DataFrame, top_n: int = 5,
                  per_section: Mapping[str, int] | None = None, vector: str = "embedding",
                  max_profile_rows: int = MAX_PROFILE_ROWS, report: dict | None = None,
                  kept: Callable[[], None] | None = None) -> DataFrame:
    """One row per posting and profile version with ``overall_similarity`` and ``matches``, whether or
    not postings have ids and whether these differ. ``overall_similarity`` is that of the overall
    row with the smallest ordinal.

    ``matches`` holds the ``top_n`` profile rows by cosine similarity, ties in profile
    order. With ``per_section`` it holds the best n rows of every named section instead.
    A posting without a vector gets 0.0 and no matches. ``profile`` has the columns
    ``profile_version, ordinal, section, embedding`` and may have the descriptive ones.
    ``report`` gets what ``cells.best_rows`` says of a profile beyond the bound. ``kept`` is called as soon as the
    rows of such a profile are kept, when what they were made from may go.
    """
    if "profile_version" not in profile.columns:
        profile = profile.withColumn("profile_version", F.lit("default"))
    rows = _bounded(profile, max_profile_rows)
    if rows is None:
        return _match_large(jobs, profile, top_n, per_section, vector, max_profile_rows, report, kept)
    if rows.num_rows == 0:
        raise ValueError("the profile has no rows")
    dims = pc.list_value_length(rows["embedding"]).drop_null()
    packed = _Profile(rows, top_n, per_section, dims[0].as_py() if len(dims) else 0)
    others = [c for c in jobs.columns if c != vector]
    found = T.StructType.fromDDL(f"profile_version string, overall_similarity double, matches array<{_MATCH_DDL}>")
    # Rows whose results, texts included, are written at once.
    step = max(1, _OUTPUT_BYTES // packed.bytes_per_row())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in [*others, vector]}
            for at in range(0, batch.num_rows, step):
                lists = _score_batch(packed, columns[vector].slice(at, step))
                row = pa.array(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())) + at)
                yield pa.RecordBatch.from_arrays(
                    [*(columns[c].take(row) for c in others), *lists.flatten().flatten()],
                    [*others, "profile_version", "overall_similarity", "matches"])

    return jobs.select(*others, vector).mapInArrow(score, T.StructType([*[jobs.schema[c] for c in others], *found.fields]))


def _score_batch(packed: _Profile, vectors: pa.Array) -> pa.Array:
    n, versions = len(vectors), len(packed.groups)
    # Parts arrive version by version within a chunk; the output wants, per posting, one
    # struct per version, so each version is assembled on its own and interleaved.
    parts: dict = {}
    for version, _, present, whole, picked, sims in packed.best(vectors):
        kept = np.repeat(present, picked.shape[1]).reshape(picked.shape)
        counts = kept.sum(axis=1)
        parts.setdefault(version, []).append((
            np.zeros(len(present)) if whole is None else np.where(present, whole, 0.0),
            counts, packed.match_struct(picked[kept], sims[kept])))
    columns = []
    for version, chunks in parts.items():
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([c[1] for c in chunks]))]).astype("int32")
        structs = pa.concat_arrays([c[2] for c in chunks])
        columns.append(pa.StructArray.from_arrays(
            [pa.array([version] * n, pa.string()), pa.array(np.concatenate([c[0] for c in chunks])),
             pa.ListArray.from_arrays(pa.array(offsets), structs)],
            names=["profile_version", "overall_similarity", "matches"]))
    if not n:
        return pa.array([], pa.list_(pa.struct([
            ("profile_version", pa.string()), ("overall_similarity", pa.float64()),
            ("matches", pa.list_(pa.struct([("ordinal", pa.int32()), *[(m, pa.string()) for m in _META],
                                            ("similarity", pa.float64())])))])))
    stacked = pa.concat_arrays(columns)
    interleave = pa.array(np.arange(n * versions).reshape(versions, n).T.reshape(-1))
    offsets = pa.array(np.arange(0, n * versions + 1, versions, dtype="int32"))
    return pa.ListArray.from_arrays(offsets, stacked.take(interleave))


def _match_large(jobs, profile, top_n, per_section, vector, max_rows, report, kept=None) -> DataFrame:
    """The exact match for a profile that does not fit one task: ``best_rows`` over groups of its rows, one
    a version (and section), and one of the first overall row of each version. Postings and rows are
    known by numbers given before the split, so equal and null ids stay apart, and the texts of rows
    are joined to the best ones only."""
    jobs = stored(jobs.withColumn("_posting", F.monotonically_increasing_id()))
    others = [c for c in jobs.columns if c not in (vector, "_posting")]
    columns = [c for c in ("profile_version", "ordinal", *_META, "embedding") if c in profile.columns]
    profile = written(profile.select(*columns).withColumn("_row", F.monotonically_increasing_id()))
    if kept is not None:
        kept()
    released(jobs.sparkSession)
    first = profile.filter(F.col("embedding").isNotNull()).select(F.size("embedding")).limit(1).collect()
    dim = first[0][0] if first else 0
    named = F.struct(F.lit("best").alias("kind"), "profile_version", *(["section"] if per_section is not None else []))
    limit = F.lit(top_n)
    if per_section is not None:
        limit = F.element_at(F.create_map(*[F.lit(x) for pair in per_section.items() for x in pair]), F.col("section"))
        profile_rows = profile.filter(F.col("section").isin(list(per_section)))
    else:
        profile_rows = profile
    columns = ["_row", "_group", "_n", "ordinal", "embedding"]
    rows = profile_rows.withColumn("_group", F.to_json(named)).withColumn("_n", limit.cast("int")).filter("_n > 0").select(*columns)
    # Only overall rows are sorted for this.
    first = profile.filter(F.col("section") == OVERALL).groupBy("profile_version").agg(F.min(F.struct("ordinal", "_row", "embedding")).alias("w"))
    first = profile.select("profile_version").distinct().alias("v").join(
        first.alias("f"), F.col("v.profile_version").eqNullSafe(F.col("f.profile_version")), "left").select("v.profile_version", "w")
    overall = stored(first.select(
        F.coalesce("w._row", F.lit(-1).cast("long")).alias("_row"), F.to_json(F.struct(F.lit("overall").alias("kind"), "profile_version")).alias("_group"),
        F.lit(1).alias("_n"), F.coalesce("w.ordinal", F.lit(0)).alias("ordinal"), F.col("w.embedding").alias("embedding")))
    asked = jobs.select("_posting", F.col(vector).alias("_vector"))
    found = best_rows(asked, rows.unionByName(overall), dim, max_rows, report)
    group = F.from_json("_group", "kind string, profile_version string, section string")
    found = stored(found.withColumn("_g", group)).withColumn("profile_version", F.col("_g.profile_version"))
    key = ["_posting", "profile_version"]
    meta = [F.col(c) if c in profile.columns else F.lit(None).cast("string").alias(c) for c in _META]
    best = found.filter("_g.kind = 'best'").join(profile.select("_row", *meta), "_row")
    place = F.lit(0)
    for i, name in enumerate(per_section or ()):
        place = F.when(F.col("section") == name, i).otherwise(place)
    match = F.struct(F.col("ordinal"), *_META, "similarity").cast(_MATCH_DDL)
    gathered = best.groupBy(*key).agg(F.array_sort(F.collect_list(
        F.struct(place.alias("p"), F.col("_rk").alias("r"), match.alias("m")))).alias("_m"))
    whole = found.filter("_g.kind = 'overall'").select(*key, F.col("similarity").alias("overall_similarity"))
    scored = whole.alias("w").join(gathered.alias("g"), (F.col("w._posting") == F.col("g._posting")) & F.col(
        "w.profile_version").eqNullSafe(F.col("g.profile_version")), "left").select("w.*", "_m")
    nothing = F.array().cast(f"array<{_MATCH_DDL}>")
    return jobs.join(scored, "_posting").select(
        *others, "profile_version", "overall_similarity",
        F.when(F.col(vector).isNotNull() & F.col("_m").isNotNull(), F.transform("_m", lambda x: x["m"])).otherwise(nothing).alias("matches"))


def explode_matches(scored: DataFrame, id_cols: Sequence[str] = ("job_id",)) -> DataFrame:
    """One row per posting, profile version and match, with its position from 1."""
    return (
        each_item(scored, "matches", [*id_cols, "profile_version"], "_m", "_p")
        .select(*id_cols, "profile_version", (F.col("_p") + 1).alias("position"), "_m.*")
    )
