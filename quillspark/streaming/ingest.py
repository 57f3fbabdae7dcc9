"""Structured Streaming: into an index, exactly once; and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.sources.index import Index


def ingest(stream: DataFrame, index: Index, checkpoint: str, name: str = "ingest", merge_every: int = 50, **trigger) -> StreamingQuery:
    """Each micro-batch is one commit; the manifest remembers the batch number, so a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        index.reload()
        if not batch.isEmpty():
            index.add_many(batch)
            index.commit((name, number))
        if len(index.manifest["segments"]) >= merge_every:
            for group in index.merge_candidates():
                index.merge(group)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name).trigger(**(trigger or {"availableNow": True})).start()


def window_counts(events: DataFrame, time: str, keys: list[str], width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts by time window and keys; late bounds the state of a stream."""
    rows = events.withWatermark(time, late) if late else events
    at = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.groupBy(at.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def session_counts(events: DataFrame, time: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
