"""Streams into the knowledge base, and event windows; extensions beyond the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeleaf.plans.engine import Engine


def index_stream(engine: Engine, folder: str, checkpoint: str, acl: str | None = None, tags: list[str] | None = None, once: bool = True) -> StreamingQuery:
    """Indexes files as they appear in a folder; each micro-batch is published as one version."""
    source = engine.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)

    def step(batch: DataFrame, _: int) -> None:
        engine.index_files(batch.select("path", "content"), acl, tags)

    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of events (ts, event_type, value), batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
