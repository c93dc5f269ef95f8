"""Named queries over the driver's tables: one per operator of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
column names match the DuckDB oracle in :mod:`snapcase.plans.oracles`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcase.functions.bins import cut_bins
from snapcase.operators import episodes as ep
from snapcase.operators import profile as pr
from snapcase.plans import params as P
from snapcase.sources.snapshots import cases

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn
    return deco


def queries() -> dict[str, Query]:
    # Import side effect: every module below registers its queries.
    from snapcase.plans import registry_ext, registry_more  # noqa: F401
    return dict(_REGISTRY)


# ---- scans and episodes -------------------------------------------------

@register("snapshot_scan")
def q_snapshot_scan(spark, sf):
    return cases(spark, sf)


@register("pretrial_rowlevel")
def q_pretrial_rowlevel(spark, sf):
    return ep.pretrial_rowlevel(cases(spark, sf), P.YEAR)


@register("episode_end")
def q_episode_end(spark, sf):
    return ep.episode_end(cases(spark, sf))


@register("pretrial_exposure")
def q_pretrial_exposure(spark, sf):
    return ep.pretrial_exposure(cases(spark, sf)).select(
        "BookingNumber", "BookingDate", "SnapshotDateTime", "Charge", "ChargeCategory",
        "ChargeDisposition", "end_pretrial")


@register("first_obs_per_episode")
def q_first_obs(spark, sf):
    return ep.first_exposed_per_episode(pr.with_age_group(cases(spark, sf)), pr.ATTRIBUTES)


@register("cut_bins")
def q_cut_bins(spark, sf):
    df = cases(spark, sf)
    return (df.select(cut_bins(F.col("CurrentAge"), 0, 100, 10).alias("age_group_10"),
                      cut_bins(F.col("CurrentAge"), 0, 100, 5).alias("age_group_5"))
              .groupBy("age_group_10", "age_group_5").agg(F.count(F.lit(1)).alias("n")))


# ---- profile tables -----------------------------------------------------

@register("profile_counts")
def q_profile_counts(spark, sf):
    first = ep.first_exposed_per_episode(pr.with_age_group(cases(spark, sf)), pr.ATTRIBUTES)
    return pr.profile_counts(first)


@register("profile_monthly_counts")
def q_profile_monthly_counts(spark, sf):
    return pr.profile_monthly_counts(cases(spark, sf), P.YEAR, "MISDEMEANOR")


@register("profile_monthly_shares")
def q_profile_monthly_shares(spark, sf):
    return pr.profile_monthly_shares(cases(spark, sf), P.YEAR, P.CATEGORIES)


@register("profile_period_shares")
def q_profile_period_shares(spark, sf):
    return pr.profile_period_shares(cases(spark, sf), P.PERIODS, P.CATEGORIES)


@register("share_display")
def q_share_display(spark, sf):
    wide = pr.profile_period_shares(cases(spark, sf), P.PERIODS, P.CATEGORIES)
    pairs = [(f"fy_{p[0]}", f"n_{p[0]}_fel", f"n_{p[0]}_mis") for p in P.PERIODS]
    return pr.share_display(wide, pairs, decimals=2)
