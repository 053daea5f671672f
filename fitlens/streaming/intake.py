"""Incremental pickup of posting files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fitlens.operators.quality import outcome_rollup
from fitlens.plans.run import Settings, absorb, preprocess_arrived
from fitlens.sources.postings import normalize_postings, parse_postings
from fitlens.sources.tables import Store


def start_intake(store: Store, settings: Settings, checkpoint: str, clean: bool = True,
                 max_files: int = 1000) -> StreamingQuery:
    """Read files that are new since the last run, append new postings and clean them.

    The stream's checkpoint remembers the files; the keyed append makes a replayed batch
    harmless. Known keys live in the table, not in streaming state, so nothing grows with
    the age of the stream. Rejected postings go to ``rejects``, the outcomes of every batch to
    ``intake_counts``."""
    spark = store.spark
    files = (
        spark.readStream.option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", max_files).text(settings.postings, wholetext=True)
        .select(F.col("_metadata.file_name").alias("file"), "value")
    )

    def take(batch: DataFrame, number: int) -> None:
        store.write("incoming", normalize_postings(parse_postings(batch), settings.source, settings.as_of))
        arrived, outcomes = absorb(store)
        counts = outcome_rollup(outcomes).withColumns({"stream": F.lit(checkpoint), "batch": F.lit(number).cast("long")})
        store.append_new("intake_counts", counts, ["stream", "batch"])
        if clean:
            preprocess_arrived(store, settings, arrived)

    return (
        files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
