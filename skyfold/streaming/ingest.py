"""Resumable ingest of delivered files: a file stream with a journal, run until no new file is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest_available(spark: SparkSession, folder: str, schema: StructType, target: str, journal: str, *, stage: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 100) -> StreamingQuery:
    """Appends the files that arrived since the last run to ``target`` and stops; the journal makes it exactly once."""
    arrived = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    staged = stage(arrived) if stage else arrived
    return staged.writeStream.format("parquet").option("path", target).option("checkpointLocation", journal).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, time: str, by: list[str], window: str, late: str) -> DataFrame:
    """Counts per tumbling window and key of a stream (or a table); rows later than ``late`` behind the watermark are dropped by the stream."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")
