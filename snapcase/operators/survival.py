"""Stays that have not ended yet (Q01): product-limit estimate of the time to disposition.

A stay without a disposition is censored on the day after its last snapshot instead of
counted as ended.  Risk sets are running sums over the aggregated durations
(``running.py``), the estimate a running sum of logarithms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapcase.operators.running import running_sums


def product_limit(stays: DataFrame, by: str = "RaceDescription") -> DataFrame:
    """Survival by group and duration: ``by, days, at_risk, ended, censored, survival``.

    ``stays`` has start, end and the flag ``ended`` (see ``episode_stays``).  A NULL group
    is a group of its own.
    """
    days = F.datediff("end", "start").cast("long")
    # Per duration: as many rows as there are different lengths of stay.
    steps = stays.groupBy(F.col(by).alias("_g"), days.alias("days")).agg(
        F.sum(F.col("ended").cast("long")).alias("ended"),
        F.sum((~F.col("ended")).cast("long")).alias("censored"))
    steps = steps.withColumn("_n", F.col("ended") + F.col("censored"))
    sums = running_sums(steps, ["_g"], "days", ["_n"])
    totals = steps.groupBy(F.col("_g").alias("_h")).agg(F.sum("_n").alias("_all"))
    risk = sums.join(totals, F.col("_g").eqNullSafe(F.col("_h"))).withColumn(
        "at_risk", F.col("_all") - F.col("_n_upto") + F.col("_n"))
    last = F.col("ended") == F.col("at_risk")
    logs = risk.withColumn("_log", F.when(last, 0.0).otherwise(
        F.log1p(-F.col("ended").cast("double") / F.col("at_risk").cast("double")))).withColumn(
        "_gone", last.cast("long"))
    out = running_sums(logs.select("_g", "days", "at_risk", "ended", "censored", "_log", "_gone"),
                       ["_g"], "days", ["_log", "_gone"])
    survival = F.when(F.col("_gone_upto") > 0, 0.0).otherwise(F.exp("_log_upto"))
    return out.select(F.col("_g").alias(by), "days", F.col("at_risk").cast("long").alias("at_risk"),
                      "ended", "censored", survival.alias("survival"))


def survival_summary(curve: DataFrame, by: str = "RaceDescription", horizon: int = 365) -> DataFrame:
    """Median (NULL if never reached) and mean up to ``horizon`` days of a product-limit estimate.

    Output: ``by, bookings, ended, median_days, restricted_mean``.  The step to the next
    duration is a window over a group's durations, of which there are at most as many as days.
    """
    order = Window.partitionBy(by).orderBy("days")
    # The estimate holds its value from one duration to the next.
    ahead = F.least(F.lead("days", 1, horizon).over(order), F.lit(horizon))
    steps = curve.withColumn("_area", F.col("survival") * F.greatest(F.lit(0), ahead - F.col("days"))).withColumn(
        "_first", F.least(F.first("days").over(order), F.lit(horizon)))
    return steps.groupBy(by).agg(
        F.max("at_risk").alias("bookings"), F.sum("ended").alias("ended"),
        F.min(F.when(F.col("survival") <= 0.5 + 1e-9, F.col("days"))).alias("median_days"),
        (F.max("_first") + F.sum("_area")).alias("restricted_mean"))
