"""Daily pre-trial headcount over a stream of snapshot files (streaming Q03).

Snapshots arrive as one file (or folder) per day.  Two chained event-time
aggregations, both bounded by a watermark:

1. per (day, booking): is every charge of the booking blank that day?
2. per day: bookings held, bookings held on pre-trial charges only.

State is kept only until the watermark passes a day; each day is emitted
once (append mode), so the sink never needs updates, and the checkpoint
makes a restarted query resume exactly where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapcase.operators.episodes import BOOKING, STATUS, TS
from snapcase.sources.snapshots import SNAPSHOT_SCHEMA


def snapshot_stream(spark: SparkSession, path: str, schema: T.StructType = SNAPSHOT_SCHEMA,
                    files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def daily_headcount(stream: DataFrame, lateness: str = "1 day", keys: Sequence[str] = BOOKING,
                    ts: str = TS, status: str = STATUS) -> DataFrame:
    """Streaming DataFrame of ``day, held, pretrial_only`` (append mode)."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    per_booking = timed.groupBy(F.window("_ts", "1 day").alias("w"), *keys).agg(
        F.min(F.col(status).isNull().cast("int")).alias("_only"))
    per_day = per_booking.groupBy(F.window(F.window_time("w"), "1 day").alias("d")).agg(
        F.count(F.lit(1)).alias("held"), F.sum("_only").cast("long").alias("pretrial_only"))
    return per_day.select(F.to_date(F.col("d.start")).alias("day"), "held", "pretrial_only")


def run_daily_headcount(stream: DataFrame, out_path: str, checkpoint: str,
                        available_now: bool = True):
    """Start the query writing parquet to ``out_path``; returns the handle."""
    writer = (daily_headcount(stream).writeStream.format("parquet").outputMode("append")
              .option("path", out_path).option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
