"""Windows over event time, on tables and on streams alike, and labels for rows as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators.annotate import annotate
from kindred.operators.search import Index


def _counted(events: DataFrame, window: Column, keys: list[str], late: str | None) -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late or "0 seconds")
    grouped = events.groupBy(window.alias("_w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "n", "value")


def tumbling(events: DataFrame, size: str, keys: list[str], late: str | None = None) -> DataFrame:
    """``(start, end, *keys, n, value)`` of windows of one size; on a stream, events later than ``late`` are dropped."""
    return _counted(events, F.window("ts", size), keys, late)


def sliding(events: DataFrame, size: str, step: str, keys: list[str], late: str | None = None) -> DataFrame:
    return _counted(events, F.window("ts", size, step), keys, late)


def sessions(events: DataFrame, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Windows that end when no event follows for ``gap``."""
    return _counted(events, F.session_window("ts", gap), keys, late)


def annotate_stream(queries: DataFrame, reference: DataFrame, sink: Callable[[DataFrame, int], None], k: int = 50, checkpoint: str | None = None, index: Index | None = None) -> StreamingQuery:
    """Labels each micro-batch of a stream (query_id, vector) from a static reference, by an ``index`` of it if given, and hands it to ``sink``, once a batch number."""
    writer = queries.writeStream.foreachBatch(lambda batch, number: sink(annotate(batch, reference, k, index=index), number))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()
