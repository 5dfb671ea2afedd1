"""Events as a stream: what a batch query says, said over readStream. Each function takes batch and stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The events' names that are taken in.
NAMES = ("click", "view", "purchase")
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def accepted(events: DataFrame) -> DataFrame:
    """Events of known names with `x` clamped to 0..1 and texts cut to 200 characters."""
    return events.where(F.col("event_type").isin(*NAMES)).withColumn("x", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))).withColumn("props", F.substring("props", 1, 200))


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts and sums of one-day windows; on a stream, events later than `late` behind the newest are dropped."""
    e = events.withColumn("_t", F.col("ts").cast("timestamp"))
    e = e.withWatermark("_t", late) if events.isStreaming else e
    g = e.groupBy(F.window("_t", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "4 hours", late: str = "1 day") -> DataFrame:
    """Session windows of each user."""
    e = events.withColumn("_t", F.col("ts").cast("timestamp"))
    e = e.withWatermark("_t", late) if events.isStreaming else e
    g = e.groupBy("user_id", F.session_window("_t", gap)).agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there, then stop; a restart goes on where the last run ended."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
