"""Hourly bars of a stream of events: watermarked, so that late events count until they are too late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def hourly_bars(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """symbol, hour, open, high, low, close, volume; works on streams and tables alike."""
    order = F.struct("ts", "event_id")
    held = events.withWatermark("ts", late).groupBy(F.col("event_type").alias("symbol"), F.window("ts", size).alias("w"))
    return held.agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", order).alias("close"), F.count("*").alias("volume")
    ).select("symbol", F.col("w.start").alias("hour"), "open", "high", "low", "close", "volume")


def write_bars(bars: DataFrame, at: str, checkpoint: str):
    """Finished hours, each once, as Parquet; ends when what is there has been read."""
    return bars.writeStream.outputMode("append").format("parquet").option("path", at).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
