"""Charge-group questions by race (Q05, Q06)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapcase.operators.episodes import BOOKING


def group_combinations_by_race(df: DataFrame, anchor: str = "DRUGS",
                               keys: Sequence[str] = BOOKING, race_col: str = "RaceDescription",
                               group_col: str = "ChargeGroup") -> DataFrame:
    """How often each other group appears in episodes that hold the anchor
    group, by race (Q05).

    Distinct (episode, race, group) rows -- at most one per group and
    episode, so even a hot episode is a few dozen rows -- then a window over
    the episode flags whether it holds the anchor.  No join against a table
    that grows with the data, and only one side of each pair exists.
    Output: ``race, charge_group, episodes, anchor_episodes, share``.
    """
    keys = list(keys)
    eg = df.filter(F.col(group_col).isNotNull()) \
           .select(*keys, F.col(race_col).alias("race"), F.col(group_col).alias("charge_group")) \
           .distinct()
    w = Window.partitionBy(*keys, "race")
    held = eg.withColumn("_anchor", F.max((F.col("charge_group") == anchor).cast("int")).over(w)) \
             .filter(F.col("_anchor") == 1)
    per_race = held.filter(F.col("charge_group") == anchor) \
                   .groupBy("race").agg(F.count(F.lit(1)).alias("anchor_episodes"))
    combos = (held.filter(F.col("charge_group") != anchor)
                  .groupBy("race", "charge_group").agg(F.count(F.lit(1)).alias("episodes")))
    # A NULL race is a race of its own.
    joined = combos.alias("c").join(per_race.alias("r"), F.expr("c.race <=> r.race"))
    return (joined.select("c.race", "charge_group", "episodes", "anchor_episodes")
                  .withColumn("share", F.col("episodes").cast("double")
                              / F.col("anchor_episodes").cast("double")))


def warrant_share(df: DataFrame, warrant: str = "WARRANT", keys: Sequence[str] = BOOKING,
                  race_col: str = "RaceDescription", group_col: str = "ChargeGroup") -> DataFrame:
    """Bookings that include a charge of the ``warrant`` group, by race (Q06).

    Output: ``race, bookings, with_warrant, share``.
    """
    per_episode = df.groupBy(*keys, F.col(race_col).alias("race")).agg(
        F.max((F.col(group_col) == warrant).cast("int")).alias("_w"))
    return per_episode.groupBy("race").agg(
        F.count(F.lit(1)).alias("bookings"),
        F.coalesce(F.sum("_w"), F.lit(0)).cast("long").alias("with_warrant")) \
        .withColumn("share", F.col("with_warrant").cast("double") / F.col("bookings").cast("double"))
