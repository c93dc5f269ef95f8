"""Queries for the recode, contingency, association, population and
extension operators (registered into :mod:`snapcase.plans.registry`)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcase.operators import association as asc
from snapcase.operators import contingency as ct
from snapcase.operators import pairs
from snapcase.operators import recode as rc
from snapcase.operators.episodes import BOOKING
from snapcase.operators.loglinear import loglinear_fit
from snapcase.plans import params as P
from snapcase.plans.registry import register
from snapcase.session import results_path
from snapcase.sources.dimensions import CATEGORY_SHORT_NAMES
from snapcase.sources.snapshots import cases

# Outputs that pass through exp/log are compared at this many decimals.
DIGITS = 8


def rounded(df: DataFrame, cols, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# ---- recoding -----------------------------------------------------------

@register("recode_group")
def q_recode_group(spark, sf):
    df = rc.recode_group(cases(spark, sf), P.RECODE_RULES)
    return df.groupBy("Charge", "ChargeGroup").agg(F.count(F.lit(1)).alias("n"))


@register("group_short_name")
def q_group_short_name(spark, sf):
    df = rc.short_names(cases(spark, sf), list(CATEGORY_SHORT_NAMES) + list(P.SHORT_NAMES))
    return df.groupBy("ChargeGroup", "ChargeGroupShort").agg(F.count(F.lit(1)).alias("n"))


# ---- flags and contingency ---------------------------------------------

def _flags(spark, sf):
    return ct.episode_flags(cases(spark, sf), drug=P.DRUG_GROUP, traffic=P.TRAFFIC_GROUP,
                            races=(P.RACE_A, P.RACE_B), rescue_pattern=P.RESCUE_PATTERN)


_RACES = (P.RACE_A, P.RACE_B)


@register("episode_flags")
def q_episode_flags(spark, sf):
    return _flags(spark, sf)


@register("freq_table")
def q_freq_table(spark, sf):
    return ct.freq_table(_flags(spark, sf))


@register("xtab3")
def q_xtab3(spark, sf):
    return ct.xtab3(_flags(spark, sf), _RACES, outcome="drugs")


@register("flat_table")
def q_flat_table(spark, sf):
    return ct.flat_table(_flags(spark, sf), _RACES)


@register("loglinear_fit")
def q_loglinear_fit(spark, sf):
    return rounded(loglinear_fit(_flags(spark, sf), _RACES), ["g2", "x2", "p_g2", "p_x2"])


@register("conditional_odds_ratio")
def q_conditional_odds_ratio(spark, sf):
    return ct.conditional_odds_ratio(_flags(spark, sf), _RACES).select(
        "orientation", "given_level", "odds_ratio")


@register("odds_ratio_ci")
def q_odds_ratio_ci(spark, sf):
    df = ct.conditional_odds_ratio(_flags(spark, sf), _RACES).select(
        "orientation", "given_level", "log_or", "ase", "lwr", "upr", "contains_one")
    return rounded(df, ["log_or", "ase", "lwr", "upr"])


# ---- association --------------------------------------------------------

_ITEM_TABLES: dict[tuple, DataFrame] = {}


def _basket_items(spark, sf, grain="basket"):
    """Distinct basket items of the two groups, written once per session and folder."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"), grain)
    if key not in _ITEM_TABLES:
        path = results_path(spark, f"basket_items/{uuid.uuid4().hex}")
        asc.basket_items(cases(spark, sf), [P.DRUG_GROUP, P.TRAFFIC_GROUP], grain=grain).write.parquet(path)
        _ITEM_TABLES[key] = spark.read.parquet(path)
    return _ITEM_TABLES[key]


def _pairs(spark, sf):
    return asc.item_pair_contingency(cases(spark, sf), P.DRUG_GROUP, P.TRAFFIC_GROUP,
                                     items=_basket_items(spark, sf))


def _v(spark, sf):
    return asc.cramers_v(_pairs(spark, sf))


def _significant(spark, sf, only=None):
    return pairs.significant_pairs(_basket_items(spark, sf), BOOKING, P.DRUG_GROUP, P.TRAFFIC_GROUP, only=only)


def _top(spark, sf):
    return pairs.top_pairs(_basket_items(spark, sf), BOOKING, P.DRUG_GROUP, P.TRAFFIC_GROUP, P.TOP_K)


@register("indicator_matrix")
def q_indicator_matrix(spark, sf):
    return asc.indicator_matrix(cases(spark, sf), P.DRUG_ITEMS + P.TRAFFIC_ITEMS,
                                [P.DRUG_GROUP, P.TRAFFIC_GROUP])


@register("item_pair_contingency")
def q_item_pair_contingency(spark, sf):
    return _pairs(spark, sf)


@register("chisq_yates")
def q_chisq_yates(spark, sf):
    return rounded(asc.chisq_yates(_pairs(spark, sf)), ["p_value"]).select(
        "x_item", "y_item", "chi2", "p_value")


@register("cramers_v")
def q_cramers_v(spark, sf):
    return _v(spark, sf).select("x_item", "y_item", "cramers_v")


@register("significant_pairs")
def q_significant_pairs(spark, sf):
    return rounded(_significant(spark, sf), ["p_value"])


@register("assoc_matrix")
def q_assoc_matrix(spark, sf):
    # Rows without a significant cell are listed as well.
    _, my = pairs.marginals(_basket_items(spark, sf), P.DRUG_GROUP, P.TRAFFIC_GROUP)
    empty = my.select(F.lit(None).cast("string").alias("x_item"), "y_item",
                      F.lit(None).cast("double").alias("cramers_v"))
    v = _significant(spark, sf).select("x_item", "y_item", "cramers_v")
    return asc.assoc_matrix(v.unionByName(empty), P.DRUG_ITEMS)


@register("assoc_topk")
def q_assoc_topk(spark, sf):
    return _top(spark, sf)


@register("assoc_topk_cross")
def q_assoc_topk_cross(spark, sf):
    top = _top(spark, sf)
    only = F.broadcast(asc.top_items(top, P.DRUG_GROUP, P.TRAFFIC_GROUP))
    return asc.assoc_topk_cross(_significant(spark, sf, only), P.TOP_K, top=top)


@register("pair_breakdown")
def q_pair_breakdown(spark, sf):
    return asc.pair_breakdown(cases(spark, sf), _top(spark, sf), exclude=P.EXCLUDED_RACES)


# ---- population comparison ---------------------------------------------

from snapcase.operators import population as pop  # noqa: E402
from snapcase.sources.population import population_estimates  # noqa: E402


def _reference(spark, sf):
    return pop.reference_population(population_estimates(spark, sf), recode=P.POP_RACE_RECODE,
                                    merge=P.POP_MERGE, origin_label=P.POP_ORIGIN_LABEL)


def _case_side(spark, sf):
    return pop.relabel_case_ages(pop.case_population(cases(spark, sf), P.YEAR, P.CASE_EXCLUDED))


def _pyramid(spark, sf):
    return pop.population_compare(_reference(spark, sf), _case_side(spark, sf))


@register("population_filter")
def q_population_filter(spark, sf):
    return pop.population_filter(population_estimates(spark, sf), recode=P.POP_RACE_RECODE)


@register("merge_categories")
def q_merge_categories(spark, sf):
    detail = pop.population_filter(population_estimates(spark, sf), recode=P.POP_RACE_RECODE)
    return pop.merge_categories(detail, "Race", P.POP_MERGE[0], P.POP_MERGE[1], "ref_count")


@register("marginal_category")
def q_marginal_category(spark, sf):
    return _reference(spark, sf)


@register("count_complete")
def q_count_complete(spark, sf):
    return pop.case_population(cases(spark, sf), P.YEAR, P.CASE_EXCLUDED)


@register("relabel_age")
def q_relabel_age(spark, sf):
    return _case_side(spark, sf)


@register("population_compare")
def q_population_compare(spark, sf):
    return _pyramid(spark, sf)


@register("group_composition")
def q_group_composition(spark, sf):
    return pop.group_composition(_pyramid(spark, sf))


@register("actual_vs_expected")
def q_actual_vs_expected(spark, sf):
    return pop.actual_vs_expected(_pyramid(spark, sf))


# ---- extensions over episodes ------------------------------------------

from snapcase.operators import charges as ch  # noqa: E402
from snapcase.operators import stays as st  # noqa: E402
from snapcase.sources.sinks import read_result, write_result  # noqa: E402


@register("pretrial_days")
def q_pretrial_days(spark, sf):
    return st.pretrial_days(cases(spark, sf))


@register("booking_days_cost")
def q_booking_days_cost(spark, sf):
    return st.booking_days_cost(cases(spark, sf), P.PERIODS, rate=P.DAY_RATE)


@register("daily_pretrial_headcount")
def q_daily_pretrial_headcount(spark, sf):
    return st.daily_pretrial_headcount(cases(spark, sf))


@register("group_combinations_by_race")
def q_group_combinations_by_race(spark, sf):
    return ch.group_combinations_by_race(cases(spark, sf), anchor=P.DRUG_GROUP)


@register("warrant_share")
def q_warrant_share(spark, sf):
    return ch.warrant_share(cases(spark, sf), warrant=P.WARRANT_GROUP)


@register("initial_and_final_charges")
def q_initial_and_final_charges(spark, sf):
    return st.initial_and_final_charges(cases(spark, sf))


@register("result_tables")
def q_result_tables(spark, sf):
    write_result(ct.freq_table(_flags(spark, sf)), "freq_table")
    return read_result(spark, "freq_table")



# ---- stratified models and the literal item grain ----------------------

def _flags_by_year(spark, sf):
    df = cases(spark, sf).withColumn("booking_year", F.year("BookingDate"))
    return ct.episode_flags(df, drug=P.DRUG_GROUP, traffic=P.TRAFFIC_GROUP,
                            races=(P.RACE_A, P.RACE_B), rescue_pattern=P.RESCUE_PATTERN,
                            strata=["booking_year"])


@register("loglinear_fit_by_year")
def q_loglinear_fit_by_year(spark, sf):
    return rounded(loglinear_fit(_flags_by_year(spark, sf), _RACES, strata=["booking_year"]),
                   ["g2", "x2", "p_g2", "p_x2"])


@register("odds_ratio_by_year")
def q_odds_ratio_by_year(spark, sf):
    df = ct.conditional_odds_ratio(_flags_by_year(spark, sf), _RACES, strata=["booking_year"])
    return rounded(df.select("booking_year", "orientation", "given_level", "odds_ratio", "lwr",
                             "upr", "contains_one"), ["odds_ratio", "lwr", "upr"])


@register("item_pair_contingency_item_grain")
def q_item_pair_contingency_item_grain(spark, sf):
    return asc.item_pair_contingency(cases(spark, sf), P.DRUG_GROUP, P.TRAFFIC_GROUP, grain="item",
                                     items=_basket_items(spark, sf, "item"))


@register("xtab3_given_drugs")
def q_xtab3_given_drugs(spark, sf):
    return ct.xtab3(_flags(spark, sf), _RACES, outcome="traffic")
