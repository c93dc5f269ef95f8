"""Episodes from snapshots: row-level pre-trial (C04), episode end (C05),
pre-trial exposure (C06) and first observation per episode (C07).

An episode is one (BookingNumber, BookingDate).  A snapshot row is
*pre-trial* when its disposition is blank; an episode *ends* on the first day
any of its rows carries a disposition.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOOKING = ("BookingNumber", "BookingDate")
TS = "SnapshotDateTime"
STATUS = "ChargeDisposition"


def ts_literal(df: DataFrame, column: str, value: dt.date | dt.datetime | str) -> Column:
    """A literal of the column's own type, so comparisons push into the scan."""
    return F.lit(str(value)).cast(df.schema[column].dataType)


def in_year(df: DataFrame, year: int, ts: str = TS) -> Column:
    """``year(ts) == year`` written as a half-open range (prunable)."""
    return (F.col(ts) >= ts_literal(df, ts, dt.date(year, 1, 1))) & \
           (F.col(ts) < ts_literal(df, ts, dt.date(year + 1, 1, 1)))


def pretrial_rowlevel(df: DataFrame, year: int, ts: str = TS, status: str = STATUS) -> DataFrame:
    """Snapshot rows with a blank disposition taken in ``year``."""
    return df.filter(F.col(status).isNull() & in_year(df, year, ts))


def episode_end(df: DataFrame, keys: Sequence[str] = BOOKING, ts: str = TS,
                status: str = STATUS, id_col: str | None = None,
                start_col: str | None = None) -> DataFrame:
    """First disposition day per episode.

    Keeps episodes that ever get a disposition and whose start day is on or
    after the first snapshot day of all bookings that ever get one (a scalar
    over the whole table).  Output: ``keys + [end_pretrial]``.

    Plan: one aggregation of the snapshot table to episode grain (partial
    aggregation map-side, so a hot episode costs one row per task).  The
    scalar subquery and the result use the same aggregate and AQE reuses its
    shuffle, so the rows are scanned once.
    """
    keys = list(keys)
    id_col = id_col or keys[0]
    start_col = start_col or keys[-1]
    day = F.to_date(F.col(ts))
    per_episode = df.groupBy(*keys).agg(
        F.min(day).alias("_first_day"),
        F.min(F.when(F.col(status).isNotNull(), day)).alias("end_pretrial"))
    # A booking number "has a disposition" if any of its episodes does.
    per_id = per_episode.groupBy(id_col).agg(
        F.min("_first_day").alias("_first_day"),
        F.max(F.col("end_pretrial").isNotNull().cast("int")).alias("_has"))
    first_day = per_id.filter(F.col("_has") == 1).agg(F.min("_first_day")).scalar()
    # Both predicates refer to aggregate outputs, so neither is pushed below
    # the aggregation: the result and the scalar subquery then run the same
    # episode aggregate and AQE reuses its shuffle (one pass over the rows).
    keep = (F.col("end_pretrial").isNotNull() & (F.col("_first_day") <= F.col("end_pretrial"))
            & ((F.to_date(F.col(start_col)) >= first_day) | F.col("end_pretrial").isNull()))
    return per_episode.filter(keep).select(*keys, "end_pretrial")


def first_tracked_day(df: DataFrame, id_col: str = BOOKING[0], ts: str = TS,
                      status: str = STATUS) -> Column:
    """First snapshot day of all bookings that ever get a disposition (a scalar)."""
    per_id = df.groupBy(id_col).agg(
        F.min(F.to_date(F.col(ts))).alias("_day"), F.max(F.col(status).isNotNull()).alias("_has"))
    return per_id.filter(F.col("_has") & F.col(id_col).isNotNull()).agg(F.min("_day")).scalar()


def pretrial_exposure(df: DataFrame, ends: DataFrame | None = None,
                      keys: Sequence[str] = BOOKING, ts: str = TS,
                      status: str = STATUS) -> DataFrame:
    """Snapshot rows of ended episodes taken strictly before the end day.

    The inner join on the episode keys carries the semi-join and the start-day
    filter of C05.  It is a sort-merge join: neither side is ever broadcast on
    a file-size estimate -- compressed parquet understates the raw rows ~10x --
    both sides spill, and AQE splits the partition of a hot episode.
    """
    keys = list(keys)
    ends = ends if ends is not None else episode_end(df, keys, ts, status)
    return (df.join(ends.hint("merge"), keys, "inner")
              .filter(F.to_date(F.col(ts)) < F.col("end_pretrial")))


def before_end(first: DataFrame, ends: DataFrame, keys: Sequence[str] = BOOKING,
               ts: str = TS) -> DataFrame:
    """Rows that are the first of their group and lie strictly before the episode's end.

    The days before the end are the earliest of an episode, so the first row of any group
    within it is before the end if any row of the group is.  Groups are aggregated before
    they meet the ends: the join sees one row for each, not the raw rows.
    """
    return (first.join(ends.hint("merge"), list(keys), "inner")
                 .filter(F.to_date(F.col(ts)) < F.col("end_pretrial")).drop("end_pretrial"))


def first_exposed_per_episode(df: DataFrame, carry: Sequence[str], keys: Sequence[str] = BOOKING,
                              ts: str = TS, status: str = STATUS) -> DataFrame:
    """First row of each ended episode, if it is before the end (C07 over C06): no join.

    First row, first day and end come out of one aggregation to episode grain.
    """
    keys = list(keys)
    day = F.to_date(F.col(ts))
    fields = [ts] + [c for c in carry if c != ts]
    per_episode = df.groupBy(*keys).agg(
        F.min(F.struct(*[F.col(c) for c in fields])).alias("_first"),
        F.min(F.when(F.col(status).isNotNull(), day)).alias("_end"))
    since = first_tracked_day(df, keys[0], ts, status)
    return (per_episode.filter(F.col("_end").isNotNull() & (F.to_date(F.col(keys[-1])) >= since)
                               & (F.to_date(F.col(f"_first.{ts}")) < F.col("_end")))
            .select(*keys, *[F.col(f"_first.{c}") for c in fields]))


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    carry: Sequence[str] = ()) -> DataFrame:
    """One row per group: the smallest by ``order`` then ``carry``.

    ``min`` over a struct compares field by field with NULLs first, so ties
    in ``order`` are broken by the carried values and the pick is total and
    reproducible.  Being an aggregate it combines map-side: a group with a
    third of all rows never lands whole in one task.
    """
    fields = list(order) + [c for c in carry if c not in order]
    picked = F.min(F.struct(*[F.col(c) for c in fields])).alias("_first")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_first.{c}") for c in fields])


def first_obs_per_episode(df: DataFrame, carry: Sequence[str],
                          keys: Sequence[str] = BOOKING, ts: str = TS) -> DataFrame:
    """First snapshot row of each episode with the ``carry`` columns."""
    return first_per_group(df, keys, [ts], carry)
