"""Stages over a store: intake, cleaning, vectors, ranking."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlens.functions.sections import BASIC, Parser
from fitlens.functions.vectors import DEFAULT_DIM
from fitlens.lexicon import DEFAULT_LEXICON, NATURAL_KEY, Lexicon, validate_weights
from fitlens.operators.dedup import keep_first, only_new, posting_id
from fitlens.operators.quality import outcome_rollup
from fitlens.plans.clean import clean_postings
from fitlens.operators.rows import small_side
from fitlens.plans.embed import (
    VECTOR_KEY, embed_again, embed_profiles, embed_sections, new_sections, posting_sections, stale_vectors)
from fitlens.plans.score import COMPONENTS, granular_scores, rank_postings, rankings_table, score_postings
from fitlens.session import ensure_checkpoint_dir
from fitlens.sources import exports
from fitlens.sources.postings import CANONICAL, read_postings
from fitlens.sources.profile import read_profile
from fitlens.sources.tables import Store


@dataclass
class Settings:
    postings: str | None = None
    profile: str | None = None
    results: str | None = None
    source: str = "manual"
    as_of: datetime.date | None = None
    lexicon: Lexicon = DEFAULT_LEXICON
    weights: dict | None = None
    parser: Parser = BASIC
    #: A function of texts to vectors, or one that loads it once per task; ``encoder`` names it.
    embed: object = None
    load_encoder: object = None
    encoder: str | None = None
    dim: int = DEFAULT_DIM
    #: A function that loads a tagger once per task; tables of names and of verb forms.
    load_tagger: object = None
    gazetteer: DataFrame | None = None
    verbs: DataFrame | None = None
    export_csv: bool = True
    export_json: bool = True
    exported: dict = field(default_factory=dict)

    @property
    def encoder_id(self) -> str:
        """Name and dimension, stored with every vector. A function that changes what it computes
        under the same name needs another ``encoder``."""
        function = self.load_encoder or self.embed
        name = self.encoder or (getattr(function, "__qualname__", type(function).__name__) if function else "hashed")
        return f"{name}/{self.dim}"


def intake_winners(postings: DataFrame, existing: DataFrame) -> DataFrame:
    """``file, pos`` of the first good posting of every key that the existing table lacks.

    Works on the key columns alone; the group limit in front of the shuffle sends at most
    one row per key and task."""
    keys = postings.filter("reason is null").select("file", "pos", *NATURAL_KEY)
    return only_new(keep_first(keys, ["file", "pos"]), existing).select("file", "pos")


def classify_intake(postings: DataFrame, existing: DataFrame) -> DataFrame:
    """``outcome`` per posting: ``inserted`` for winners, ``duplicates`` or ``errors``."""
    return _with_outcome(postings, intake_winners(postings, existing))


def _with_outcome(postings: DataFrame, winners: DataFrame) -> DataFrame:
    won = winners.withColumn("_won", F.lit(True))
    return postings.join(won, ["file", "pos"], "left").withColumn(
        "outcome", F.when(F.col("reason").isNotNull(), "errors").when(F.col("_won"), "inserted")
        .otherwise("duplicates")).drop("_won")


def _as_raw(winning: DataFrame) -> DataFrame:
    return winning.select(posting_id().alias("job_id"), *CANONICAL, F.current_timestamp().alias("date_ingested"))


def new_raw_postings(postings: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to append to the raw table, in one pass over the postings."""
    return _as_raw(only_new(keep_first(postings.filter("reason is null"), ["file", "pos"]), existing))


def absorb(store: Store) -> tuple[DataFrame, DataFrame]:
    """Append what is new in the table of parsed postings, and its rejects. Returns the rows
    appended, and ``file, pos, reason, outcome`` of all postings.

    The winners are pinned by a checkpoint before the append, which would change what counts
    as new."""
    ensure_checkpoint_dir(store.spark)
    postings = store.read("incoming")
    existing = store.read_or_empty("raw_postings").select(*NATURAL_KEY)
    winners = intake_winners(postings, existing).checkpoint(eager=True)
    arrived = _as_raw(postings.join(winners, ["file", "pos"], "left_semi"))
    store.write("raw_postings", arrived, "append")
    store.append_new("rejects", postings.filter("reason is not null"), ["file", "pos", "reason"])
    return arrived, _with_outcome(postings.select("file", "pos", "reason"), winners)


def intake(store: Store, settings: Settings) -> DataFrame:
    """Append new postings; returns counts per file with a grand total.

    The files are parsed once, into a table of their own; rejected postings are kept in another."""
    store.write("incoming", read_postings(store.spark, settings.postings, settings.source, settings.as_of))
    return outcome_rollup(absorb(store)[1])


def _clean(store: Store, settings: Settings, raw: DataFrame) -> None:
    store.write("clean_postings", clean_postings(
        raw, settings.lexicon, settings.parser, settings.load_tagger, settings.gazetteer, settings.verbs), "append")


def preprocess(store: Store, settings: Settings) -> None:
    """Clean every raw posting that has no clean row yet. What is missing is found on ids alone."""
    raw, done = store.read("raw_postings"), store.read_or_empty("clean_postings")
    missing = small_side(only_new(raw.select("job_id"), done, ["job_id"]))
    _clean(store, settings, raw.join(missing, "job_id", "left_semi"))


def preprocess_arrived(store: Store, settings: Settings, arrived: DataFrame) -> None:
    """Clean the rows just appended, reading no older description. If other postings of the batch
    lack a clean row, as after a run that failed half-way, all that is missing is cleaned."""
    batch = store.read("incoming").filter("reason is null").select(posting_id().alias("job_id")).distinct()
    missing = only_new(batch, store.read_or_empty("clean_postings"), ["job_id"])
    if only_new(missing, arrived, ["job_id"]).isEmpty():
        _clean(store, settings, arrived)
    else:
        preprocess(store, settings)


def vectorize(store: Store, settings: Settings) -> None:
    """Embed new posting texts and, if a profile is given, the profile. Vectors of another
    encoder than that of the settings are made anew."""
    encoder = settings.encoder_id
    how = {"embed": settings.embed, "dim": settings.dim, "load": settings.load_encoder, "encoder": encoder}
    sections = posting_sections(store.read("clean_postings"))
    known = store.read_or_empty("job_embeddings")
    fresh = embed_sections(new_sections(sections, known, encoder), **how)
    # Where texts or the encoder changed since, the buckets with their vectors are written again.
    store.snapshots.upsert("job_embeddings", fresh, stale_vectors(sections, known, encoder), VECTOR_KEY)
    if settings.profile:
        profiles = read_profile(store.spark, settings.profile)
        store.write("profile_embeddings", embed_profiles(profiles, **how))
        return
    profiles = store.read_or_empty("profile_embeddings")
    if not profiles.filter(~F.col("encoder").eqNullSafe(encoder)).isEmpty():
        ensure_checkpoint_dir(store.spark)
        store.write("profile_embeddings", embed_again(profiles, **how).checkpoint(eager=True))


def rank(store: Store, settings: Settings) -> DataFrame:
    """Score and rank everything, replace the rankings of the profile versions, export."""
    jobs, profile = store.read("job_embeddings"), store.read("profile_embeddings")
    scored = score_postings(store.read("raw_postings"), store.read("clean_postings"), jobs, profile,
                            settings.lexicon, settings.weights)
    ranked = rank_postings(scored)
    store.replace_versions({"rankings": rankings_table(ranked),
                            "granular_scores": granular_scores(jobs, profile, lexicon=settings.lexicon)}, profile)
    if settings.results:
        stamp = datetime.datetime.now().strftime("%Y%m%d_%H%M%S")
        settings.exported = {"csv": f"{settings.results}/rankings_{stamp}", "json": f"{settings.results}/detailed_{stamp}"}
        exports.write_summary_csv(ranked, settings.exported["csv"], settings.export_csv)
        exports.write_detailed_json(ranked, settings.exported["json"], stamp, settings.export_json)
    return ranked


def check_inputs(store: Store, settings: Settings, skip=()) -> list[str]:
    """Problems with the inputs that the chosen stages read."""
    problems = []
    try:
        validate_weights(settings.weights or {"overall_similarity": 1.0})
    except ValueError as error:
        problems.append(str(error))
    unknown = sorted(set(settings.weights or ()) - set(COMPONENTS))
    if unknown:
        problems.append(f"no such score: {', '.join(unknown)}")
    if "intake" not in skip:
        if not settings.postings:
            problems.append("no folder of posting files given")
        elif not store.spark.read.format("binaryFile").option(
                "pathGlobFilter", "*.json").load(settings.postings).select("path").take(1):
            problems.append(f"no *.json file in {settings.postings}")
    if "intake" in skip and not store.exists("raw_postings"):
        problems.append("raw_postings is not there")
    if "preprocess" in skip and not store.exists("clean_postings"):
        problems.append("clean_postings is not there")
    if "vectorize" in skip and not (store.exists("job_embeddings") and store.exists("profile_embeddings")):
        problems.append("embeddings are not there")
    elif "vectorize" in skip and store.read("job_embeddings").select("encoder").union(
            store.read("profile_embeddings").select("encoder")).distinct().limit(2).count() > 1:
        problems.append("vectors come from several encoders")
    if "vectorize" not in skip and not settings.profile and not store.exists("profile_embeddings"):
        problems.append("no profile given")
    return problems


def run(spark: SparkSession, root: str, settings: Settings, skip=()) -> DataFrame:
    """All stages in order; a skipped stage's stored table is read instead.

    ``skip=('intake', 'preprocess', 'vectorize')`` ranks only."""
    store = Store(spark, root)
    problems = check_inputs(store, settings, skip)
    if problems:
        raise ValueError("; ".join(problems))
    for name, stage in (("intake", intake), ("preprocess", preprocess), ("vectorize", vectorize)):
        if name not in skip:
            stage(store, settings)
    return rank(store, settings)
