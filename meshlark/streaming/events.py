"""Windowed event statistics, an extension: one definition for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total): counts and sums in tumbling or sliding windows of event time; rows later than ``late`` are dropped in a stream."""
    e = events if late is None else events.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): visits that end after a gap."""
    e = events if late is None else events.withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run(spark: SparkSession, source: str, target: str, checkpoint: str, width: str = "1 hour", late: str = "1 hour") -> StreamingQuery:
    """Reads new Parquet files of a folder and appends closed windows to another, once over what is there."""
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return windowed(stream, width, late=late).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
