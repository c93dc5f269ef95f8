"""Joins of intervals through day buckets, and counts of open intervals per day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcase.operators.running import running_sums

BUCKET_DAYS = 32


def interval_join(left: DataFrame, l_start: str, l_end: str, right: DataFrame, r_start: str, r_end: str,
                  bucket: int = BUCKET_DAYS) -> DataFrame:
    """Rows of both sides whose half-open day intervals [start, end) overlap, each pair once.

    Every interval is listed in the buckets of days it touches, so the sides meet in an equal
    join on the bucket, which spreads and splits like any other.  A pair that meets in several
    buckets belongs to the one in which the later interval starts.  Empty intervals and those
    with a NULL end meet nothing.  The sides must not share column names.
    """
    def touched(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
        first, last = (F.floor(F.unix_date(c) / bucket) for c in (F.col(start), F.date_sub(end, 1)))
        return (df.filter(F.col(start) < F.col(end)).withColumn(f"_{name}_first", first)
                .withColumn("_bucket", F.explode(F.sequence(first, last))))

    met = touched(left, l_start, l_end, "l").join(touched(right, r_start, r_end, "r").hint("merge"), "_bucket")
    return (met.filter((F.col("_bucket") == F.greatest("_l_first", "_r_first"))
                       & (F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end)))
            .drop("_bucket", "_l_first", "_r_first"))


def days_by_period(stays: DataFrame, periods: DataFrame, rate: int = 82, bucket: int = BUCKET_DAYS) -> DataFrame:
    """Booking-days of the stays in each of many periods, which may overlap (Q02).

    ``periods`` has period, first_day and last_day (inclusive).
    Output: ``period, bookings, booking_days, cost``.
    """
    spans = periods.select("period", "first_day", F.date_add("last_day", 1).alias("_after"))
    met = interval_join(stays.select("start", "end"), "start", "end", spans, "first_day", "_after", bucket)
    days = F.datediff(F.least("end", "_after"), F.greatest("start", "first_day"))
    return met.groupBy("period").agg(
        F.count(F.lit(1)).alias("bookings"), F.sum(days).cast("long").alias("booking_days"),
        (F.sum(days) * F.lit(rate)).cast("long").alias("cost"))


def daily_headcount(stays: DataFrame) -> DataFrame:
    """Stays open on each day from the first start to the last end, snapshots or not (Q03).

    A stay counts on the days [start, end).  It is one event up and one down; the events are
    summed by day and added up along the calendar by ranges.  Output: ``day, held``.
    """
    events = stays.filter(F.col("start") < F.col("end")).select(F.explode(F.array(
        F.struct(F.col("start").alias("day"), F.lit(1).alias("step")),
        F.struct(F.col("end").alias("day"), F.lit(-1).alias("step")))).alias("e")).select("e.*")
    steps = events.groupBy("day").agg(F.sum("step").alias("step"))
    # The calendar is as long as the days between the two ends, whatever the number of stays.
    calendar = (steps.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a IS NOT NULL")
                .select(F.explode(F.sequence("a", "b")).alias("day")))
    filled = calendar.join(steps, "day", "left").select(
        F.lit(0).alias("one"), "day", F.coalesce("step", F.lit(0)).alias("step"))
    return running_sums(filled, ["one"], "day", ["step"]).select("day", F.col("step_upto").cast("long").alias("held"))
