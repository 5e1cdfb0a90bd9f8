"""Streams of facts: micro-batches go through the same set-based writes as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..memory import FactStore


def ingest(stream: DataFrame, store: FactStore, checkpoint: str, once: bool = True, name: str | None = None) -> StreamingQuery:
    """Writes a stream of facts (id, content, entities, effective_at, created_at, source, metadata, pos) to a store.

    The write order is that of the batches and, within one, of pos; late facts are no special case,
    as both clocks are columns. A batch that Spark replays after a stop is known by its number and
    changes nothing: name is the stream's in the store's commits, by default its checkpoint folder.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, n: store.remember_batch(rows, batch=(name or checkpoint, n)))
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, ts: str = "created_at", lateness: str = "2 days", width: str = "1 day") -> DataFrame:
    """Facts a source and window, with a watermark for late ones."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, width), "source").agg(F.count("*").alias("n"))
