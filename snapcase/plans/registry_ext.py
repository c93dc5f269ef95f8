"""Queries for the general and incremental forms of the operators (registered into
:mod:`snapcase.plans.registry`)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from snapcase.operators import association as asc
from snapcase.operators import contingency as ct
from snapcase.operators import episodes as ep
from snapcase.operators import intervals as iv
from snapcase.operators import itemsets, pairs, population as pop, profile as pr
from snapcase.operators import recode as rc
from snapcase.operators import resampling, survival, tables
from snapcase.operators import stays as st
from snapcase.operators.incremental import EpisodeState
from snapcase.plans import params as P
from snapcase.plans.registry import register
from snapcase.plans.registry_more import rounded
from snapcase.session import results_path
from snapcase.sources.snapshots import case_table, cases, edge_cases, scan_snapshots, scan_with_rejects


@register("group_itemsets_by_race")
def q_group_itemsets_by_race(spark, sf):
    return itemsets.combinations_by_race(cases(spark, sf), P.DRUG_GROUP, P.MIN_EPISODES)


def _curve(spark, sf):
    return survival.product_limit(st.episode_stays(cases(spark, sf)))


@register("pretrial_survival")
def q_pretrial_survival(spark, sf):
    return rounded(_curve(spark, sf), ["survival"])


@register("pretrial_survival_summary")
def q_pretrial_survival_summary(spark, sf):
    return rounded(survival.survival_summary(_curve(spark, sf), horizon=P.HORIZON_DAYS), ["restricted_mean"])


@register("booking_days_rolling")
def q_booking_days_rolling(spark, sf):
    stays = st.episode_stays(cases(spark, sf))
    # A period of 90 days from the first of every month with a booking.
    month = F.trunc("start", "month")
    periods = stays.select(month.alias("first_day")).distinct().select(
        F.date_format("first_day", "yyyy-MM-dd").alias("period"), "first_day",
        F.date_add("first_day", P.ROLLING_DAYS - 1).alias("last_day"))
    return iv.days_by_period(stays, periods, P.DAY_RATE)


@register("daily_headcount_from_stays")
def q_daily_headcount_from_stays(spark, sf):
    return iv.daily_headcount(st.episode_stays(cases(spark, sf)))


@register("association_tables")
def q_association_tables(spark, sf):
    df = cases(spark, sf).withColumn("booking_year", F.year("BookingDate"))
    pairs = (("race_by_group", "RaceDescription", "ChargeGroup"), ("gender_by_category", "Gender", "ChargeCategory"),
             ("marital_by_disposition", "MaritalStatus", "ChargeDisposition"))
    out = None
    for name, a, b in pairs:
        t = tables.association_table(df, a, b, ["booking_year"]).withColumn("tab", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return rounded(out, ["chi2", "p_value", "cramers_v"], 7)


@register("loglinear_all_races")
def q_loglinear_all_races(spark, sf):
    flags = ct.episode_flags(cases(spark, sf), drug=P.DRUG_GROUP, traffic=P.TRAFFIC_GROUP,
                             races=P.ALL_RACES, rescue_pattern=P.RESCUE_PATTERN)
    return rounded(tables.loglinear_models(flags, ["race", "drugs", "traffic"], tables.standard_models()),
                   ["g2", "x2", "p_g2", "p_x2"], 7)


@register("race_share_intervals")
def q_race_share_intervals(spark, sf):
    return rounded(resampling.share_intervals(cases(spark, sf), "RaceDescription", ["BookingNumber"]),
                   ["share", "lower", "upper"])


@register("episode_state")
def q_episode_state(spark, sf):
    df = cases(spark, sf)
    state = EpisodeState(spark, [c for c in pr.with_age_group(df).columns if c in pr.ATTRIBUTES])
    # Yearly batches, the last of them twice.
    bounds = df.agg(F.min(F.year(ep.TS)).alias("a"), F.max(F.year(ep.TS)).alias("b")).first()
    if bounds.a is None:
        state.add(pr.with_age_group(df))
    else:
        for year in [*range(bounds.a, bounds.b + 1), bounds.b]:
            state.add(pr.with_age_group(df.filter(ep.in_year(df, year))))
    return state.first_exposed()


@register("share_display_monthly")
def q_share_display_monthly(spark, sf):
    wide = pr.profile_monthly_shares(cases(spark, sf), P.YEAR, P.CATEGORIES)
    return pr.share_display(wide, [(m, f"{m}_fel", f"{m}_mis") for m in pr.MONTHS], decimals=1)


def _extract(spark, df) -> str:
    """The rows as CSV files with headers, as an extract of snapshots arrives."""
    path = results_path(spark, f"extracts/{uuid.uuid4().hex}")
    df.write.option("header", True).csv(path)
    return path


@register("snapshot_scan_csv")
def q_snapshot_scan_csv(spark, sf):
    return scan_snapshots(spark, _extract(spark, case_table(spark, sf)), fmt="csv")


@register("snapshot_rejects")
def q_snapshot_rejects(spark, sf):
    # Ages and days of some bookings are written as text that does not parse.
    faulty = case_table(spark, sf).withColumns({
        "CurrentAge": F.when(F.col("BookingNumber") % 97 == 0, F.concat(F.lit("age "), F.col("CurrentAge")))
                       .otherwise(F.col("CurrentAge").cast("string")),
        "SnapshotDateTime": F.when(F.col("BookingNumber") % 89 == 0, F.lit("some day"))
                             .otherwise(F.col("SnapshotDateTime").cast("string"))})
    typed, rejects = scan_with_rejects(spark, _extract(spark, faulty), bad={})
    def count(column) -> F.Column:
        return typed.agg(F.count(column)).scalar()

    return rejects.groupBy("column", "text").agg(F.count(F.lit(1)).alias("cells")).select(
        "column", "text", "cells", count(F.lit(1)).alias("rows"), count("CurrentAge").alias("ages"),
        count("SnapshotDateTime").alias("days"))


# ---- the same operators over a table with awkward values ---------------------

@register("edge_recode_group")
def q_edge_recode_group(spark, sf):
    df = rc.recode_group(edge_cases(spark, sf), P.RECODE_RULES)
    return df.groupBy("Charge", "ChargeGroup").agg(F.count(F.lit(1)).alias("n"))


@register("edge_profile_counts")
def q_edge_profile_counts(spark, sf):
    first = ep.first_exposed_per_episode(pr.with_age_group(edge_cases(spark, sf)), pr.ATTRIBUTES)
    return pr.profile_counts(first)


def _edge_counts(spark, sf):
    return pop.case_population(edge_cases(spark, sf), P.YEAR, P.CASE_EXCLUDED)


@register("edge_count_complete")
def q_edge_count_complete(spark, sf):
    return _edge_counts(spark, sf)


@register("edge_relabel_age")
def q_edge_relabel_age(spark, sf):
    return pop.relabel_case_ages(_edge_counts(spark, sf))


@register("edge_relabel_age_published")
def q_edge_relabel_age_published(spark, sf):
    return pop.relabel_case_ages(_edge_counts(spark, sf), old_bands=pop.OLD_AGES_PUBLISHED)


def _edge_items(spark, sf):
    return asc.basket_items(edge_cases(spark, sf), [P.DRUG_GROUP, P.TRAFFIC_GROUP])


@register("edge_cramers_v")
def q_edge_cramers_v(spark, sf):
    v = asc.cramers_v(asc.item_pair_contingency(None, P.DRUG_GROUP, P.TRAFFIC_GROUP, items=_edge_items(spark, sf)))
    return v.select("x_item", "y_item", "cramers_v")


@register("edge_significant_pairs")
def q_edge_significant_pairs(spark, sf):
    return rounded(pairs.significant_pairs(_edge_items(spark, sf), ep.BOOKING, P.DRUG_GROUP, P.TRAFFIC_GROUP),
                   ["p_value"])


@register("edge_assoc_topk")
def q_edge_assoc_topk(spark, sf):
    return pairs.top_pairs(_edge_items(spark, sf), ep.BOOKING, P.DRUG_GROUP, P.TRAFFIC_GROUP, P.TOP_K)


@register("edge_pretrial_days")
def q_edge_pretrial_days(spark, sf):
    return st.pretrial_days(edge_cases(spark, sf))


@register("edge_group_itemsets")
def q_edge_group_itemsets(spark, sf):
    return itemsets.combinations_by_race(edge_cases(spark, sf), P.DRUG_GROUP, P.MIN_EPISODES)
