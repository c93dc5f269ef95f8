"""Questions about pre-trial stays built on episodes (Q01-Q03, Q07).

Q01 mean pre-trial days by attribute, Q02 booking-days and cost per period,
Q03 daily pre-trial-only headcount, Q07 charges at booking vs at release.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapcase.functions.bins import cut_bins
from snapcase.operators.episodes import BOOKING, STATUS, TS, first_tracked_day

DIMENSIONS = (("Race", "RaceDescription"), ("Gender", "Gender"), ("Age", "age_group"),
              ("Category", "category"))


def episode_stays(df: DataFrame, keys: Sequence[str] = BOOKING, ts: str = TS,
                  status: str = STATUS, felony: str = "FELONY",
                  category_col: str = "ChargeCategory") -> DataFrame:
    """Stay and attributes of each episode that started while snapshots were taken.

    The stay begins on the booking day and ends on the first day with a
    disposition or, without one, on the day after the last snapshot.  A stay
    that would end before its booking day is invalid and left out.  Attributes
    are those of the first snapshot row; the category is ``felony`` when any
    charge is, else the one seen first.

    One aggregation, map-side combined.
    Output: ``keys, start, end, RaceDescription, Gender, age_group, category, ended``
    (``ended``: the end is a disposition).
    """
    keys = list(keys)
    day = F.to_date(F.col(ts))
    first = F.min(F.struct(F.col(ts), F.col("RaceDescription"), F.col("Gender"),
                           F.col("CurrentAge"), F.col(category_col)))
    agg = df.groupBy(*keys).agg(
        first.alias("_f"), F.max((F.col(category_col) == felony).cast("int")).alias("_fel"),
        F.min(F.when(F.col(status).isNotNull(), day)).alias("_end"),
        F.date_add(F.max(day), 1).alias("_after"))
    agg = agg.withColumn("end", F.coalesce("_end", "_after")).withColumn("ended", F.col("_end").isNotNull())
    start = F.to_date(F.col(keys[-1]))
    since = first_tracked_day(df, keys[0], ts, status)
    return agg.filter((start >= since) & (F.col("end") >= start)).select(
        *keys, start.alias("start"), "end", F.col("_f.RaceDescription").alias("RaceDescription"),
        F.col("_f.Gender").alias("Gender"),
        cut_bins(F.col("_f.CurrentAge"), 0, 100, 10).alias("age_group"),
        F.when(F.col("_fel") == 1, F.lit(felony)).otherwise(F.col(f"_f.{category_col}")).alias("category"),
        "ended")


def pretrial_days(df: DataFrame, stays: DataFrame | None = None,
                  dims: Sequence[tuple[str, str]] = DIMENSIONS) -> DataFrame:
    """Mean days of the stays, overall and by each attribute (Q01).

    Output: ``dimension, level, bookings, total_days, mean_days``; the overall
    row has dimension ``All``.
    """
    stays = stays if stays is not None else episode_stays(df)
    stays = stays.withColumn("days", F.datediff("end", "start"))
    names = [n for n, _ in dims]
    wide = stays.select("days", F.lit("All").alias("All"),
                        *[F.col(c).cast("string").alias(n) for n, c in dims])
    long = wide.unpivot(["days"], ["All", *names], "dimension", "level")
    return long.groupBy("dimension", "level").agg(
        F.count(F.lit(1)).alias("bookings"), F.sum("days").cast("long").alias("total_days"),
        (F.sum("days").cast("double") / F.count(F.lit(1)).cast("double")).alias("mean_days"))


def booking_days_cost(df: DataFrame, periods, rate: int = 82,
                      stays: DataFrame | None = None) -> DataFrame:
    """Pre-trial booking-days that fall in each period, and their cost (Q02).

    A stay covers days [booking day, end day); its overlap with an inclusive
    period [start, end] is counted.  Periods are a literal list, so each
    stay is expanded against them in place (no join).
    Output: ``period, bookings, booking_days, cost``.
    """
    stays = stays if stays is not None else episode_stays(df)
    arr = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("start"),
                             F.lit(e).alias("end")) for n, s, e in periods])
    per = stays.select(F.col("start").alias("_s"), F.col("end").alias("_e"),
                       F.explode(arr).alias("_p"))
    overlap = F.datediff(F.least(F.col("_e"), F.date_add(F.col("_p.end"), 1)),
                         F.greatest(F.col("_s"), F.col("_p.start")))
    per = per.select(F.col("_p.name").alias("period"), overlap.alias("days")) \
             .filter(F.col("days") > 0)
    return per.groupBy("period").agg(
        F.count(F.lit(1)).alias("bookings"), F.sum("days").cast("long").alias("booking_days"),
        (F.sum("days") * F.lit(rate)).cast("long").alias("cost"))


def daily_pretrial_headcount(df: DataFrame, keys: Sequence[str] = BOOKING, ts: str = TS,
                             status: str = STATUS) -> DataFrame:
    """Bookings held per day, and those held on pre-trial charges only (every
    charge of the booking blank that day) (Q03), averaged per month.

    Output: ``month, days, avg_held, avg_pretrial_only``.
    """
    day = F.to_date(F.col(ts))
    per_booking_day = df.groupBy(day.alias("day"), *keys).agg(
        F.min(F.col(status).isNull().cast("int")).alias("_only"))
    per_day = per_booking_day.groupBy("day").agg(
        F.count(F.lit(1)).alias("held"), F.sum("_only").alias("pretrial_only"))
    return per_day.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("days"),
        (F.sum("held").cast("double") / F.count(F.lit(1)).cast("double")).alias("avg_held"),
        (F.sum("pretrial_only").cast("double") / F.count(F.lit(1)).cast("double"))
        .alias("avg_pretrial_only"))


def initial_and_final_charges(df: DataFrame, keys: Sequence[str] = BOOKING, ts: str = TS,
                              item: str = "ChargeGroup", missing: str = "Missing") -> DataFrame:
    """Episodes holding each charge group at their first snapshot (booking)
    and at their last (release) (Q07); every row of a tied day counts.

    One aggregation to (episode, group) with its first and last time; the
    episode's own are a window over those rows, of which an episode has one
    for each charge group.
    Output: ``charge_group, at_booking, at_release``.
    """
    keys = list(keys)
    groups = df.groupBy(*keys, F.coalesce(F.col(item), F.lit(missing)).alias("charge_group")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    episode = Window.partitionBy(*keys)
    per_episode = groups.select(
        "charge_group",
        (F.col("_first") == F.min("_first").over(episode)).cast("int").alias("_b"),
        (F.col("_last") == F.max("_last").over(episode)).cast("int").alias("_r")) \
        .filter((F.col("_b") == 1) | (F.col("_r") == 1))
    return per_episode.groupBy("charge_group").agg(
        F.sum("_b").cast("long").alias("at_booking"), F.sum("_r").cast("long").alias("at_release"))


__all__ = ["pretrial_days", "booking_days_cost", "daily_pretrial_headcount",
           "initial_and_final_charges", "episode_stays"]
