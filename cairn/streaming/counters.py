"""Streaming counters over an event log, with a watermark and protection against replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """An append-only event log as a stream of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, at: str = "ts", lateness: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events and values by type and tumbling window; later rows than ``lateness`` are left out.

    Replayed events count once: ids are deduplicated within the watermark.
    """
    timely = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness).dropDuplicatesWithinWatermark(["event_id"])
    return timely.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what there is to a Parquet sink, exactly once."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
