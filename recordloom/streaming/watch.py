"""Streams: a watched folder, latest-wins upserts, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordloom.operators.lifecycle import chew_state, latest
from recordloom.sources import files as readers
from recordloom.sources.store import Store

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], every: str | None = "3 seconds") -> StreamingQuery:
    """New files of a folder, each once, as text with its state, to ``sink(batch, number)``. Names and folders that are no input
    are left out; files that need a converter are FAILED, with the reason. The checkpoint is the set of known files. Without ``every`` what is there is worked off and the stream ends."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(folder)
    binary = readers.suffix_of("path").isin(*readers.CONVERTED)
    text = readers.incoming(files).select("path", F.sha2("content", 256).alias("sha256"), F.when(~binary, readers.as_text("content")).alias("text"), F.when(binary, F.lit("needs a converter")).alias("error"))
    writer = chew_state(text, error="error").writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def upsert_sink(store: Store, name: str, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the last row of each key, by the order and not by arrival; a batch that is delivered again, or late,
    changes nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.upsert(name, latest(batch, key, order), key, order)

    return sink


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """window_start, event_type, n, total of a stream or table of events (ts, event_type, value)."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
