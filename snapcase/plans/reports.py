"""The published reports as one-call plans over a snapshot table.

Each function takes the snapshot DataFrame (e.g. from
:func:`snapcase.sources.snapshots.scan_snapshots`) and returns lazy
DataFrames.  The defaults are the parameters of the original analysis;
every one can be overridden.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcase.operators import association as asc
from snapcase.operators import contingency as ct
from snapcase.operators import pairs
from snapcase.operators import population as pop
from snapcase.operators import profile as pr
from snapcase.operators.episodes import BOOKING, episode_end
from snapcase.operators.loglinear import loglinear_fit
from snapcase.operators.recode import recode_group
from snapcase.session import shared_dir
from snapcase.sources.dimensions import period

# Charge-level category corrections, applied in this order
# (a later rule for the same charge wins).
CHARGE_CORRECTIONS = (
    ("TAMPERING WITH PHYSICAL EVIDENCE", "HINDERING/INTIMIDATING"),
    ("COMPLICITY TAMPERING WITH PHYSICAL EVIDENCE", "HINDERING/INTIMIDATING"),
    ("TRAFFICKING IN SYNTHETIC DRUGS 1ST OFFENSE- CLASS A MISD", "DRUGS"),
    ("POSSESSION OF STOLEN MAIL", "THEFT"),
    ("ILLEGAL POSSESSION OF LEGEND DRUG", "DRUGS"),
    ("DRUG PARAPHERNALIA-ADVERTISEMENT", "DRUGS"),
    ("POSSESSION OF STOLEN MAIL", "GENERAL FELONY"),
    ("TRAFFICKING IN FINANCIAL INFORMATION", "GENERAL FELONY"),
    ("OPERATING ON SUSPENDED OR REVOKED OPERATORS LICENSE", "TRAFFIC"),
    ("FAILURE TO WEAR SEAT BELTS", "TRAFFIC"),
    ("LOITERING", "LOITERING"),
)

# Reporting periods, year, groups, compared races and filters.
FISCAL_PERIODS = (period("1415", "2014-07-11", "2015-06-30"),
                  period("1516", "2015-07-01", "2016-06-29"))
STAY_PERIODS = (period("18", "2017-07-01", "2018-06-30"), period("19", "2018-07-01", "2019-03-31"))
REPORT_YEAR = 2015
DRUGS, TRAFFIC = "DRUGS", "TRAFFIC"
RACES = ("Black-origins of Africa", "White/Eurp/ N.Afr/Mid Eas")
RESCUE_PATTERN = "POSS CONT SUB"
EXCLUDED_RACES = ("Other", "UNKNOWN")
TOP_K = 20
# Columns that the association matrix shows at most.
MATRIX_COLUMNS = 1000


def fiscal_profile(df: DataFrame, periods=FISCAL_PERIODS) -> dict[str, DataFrame]:
    """Pre-trial profile by fiscal period: shares and the merged display."""
    ends = episode_end(df)
    shares = pr.profile_period_shares(df, periods, ends=ends)
    columns = [(f"fy_{p[0]}", f"n_{p[0]}_fel", f"n_{p[0]}_mis") for p in periods]
    return {"shares": shares, "display": pr.share_display(shares, columns, decimals=2)}


def monthly_profile(df: DataFrame, year: int = REPORT_YEAR) -> dict[str, DataFrame]:
    """Pre-trial profile by month of ``year`` (felony and misdemeanour)."""
    shares = pr.profile_monthly_shares(df, year)
    columns = [(m, f"{m}_fel", f"{m}_mis") for m in pr.MONTHS]
    return {"shares": shares, "display": pr.share_display(shares, columns, decimals=1),
            "misdemeanour_counts": pr.profile_monthly_counts(df, year, "MISDEMEANOR")}


def association(df: DataFrame, drug: str = DRUGS, traffic: str = TRAFFIC, races=RACES,
                corrections=CHARGE_CORRECTIONS, k: int = TOP_K,
                rescue_pattern: str = RESCUE_PATTERN,
                exclude=EXCLUDED_RACES) -> dict[str, DataFrame]:
    """Drug x traffic charge association and the race-stratified models.

    The basket items are checkpointed and the top pairs found when this is called.  ``pairs``
    holds the pairs with a significant V, ``matrix`` the same as a table with a column for
    each drug charge that has one (at most ``MATRIX_COLUMNS``).
    """
    fixed = recode_group(df, corrections)
    shared_dir(df.sparkSession)
    items = asc.basket_items(fixed, [drug, traffic]).checkpoint()
    significant = pairs.significant_pairs(items, BOOKING, drug, traffic).checkpoint()
    top = pairs.top_pairs(items, BOOKING, drug, traffic, k)
    columns = [r.x_item for r in significant.select("x_item").distinct().orderBy("x_item")
               .limit(MATRIX_COLUMNS).collect()]
    flags = ct.episode_flags(fixed, drug=drug, traffic=traffic, races=races,
                             rescue_pattern=rescue_pattern)
    by_race = asc.pair_breakdown(fixed, top, exclude=exclude)
    return {
        "pairs": significant,
        "matrix": asc.assoc_matrix(significant, columns),
        "top": top,
        "top_cross": asc.assoc_topk_cross(significant, k, top=top),
        "by_race": by_race,
        "by_race_display": rounded(by_race, {"cramers_v": 5, "proportion": 2}),
        "freq": ct.freq_table(flags),
        "xtab_drugs_given_traffic": ct.xtab3(flags, races, outcome="drugs"),
        "xtab_traffic_given_drugs": ct.xtab3(flags, races, outcome="traffic"),
        "flat": ct.flat_table(flags, races),
        "loglinear": loglinear_fit(flags, races),
        "odds_ratios": ct.conditional_odds_ratio(flags, races),
    }


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Columns rounded half to even for display."""
    return df.withColumns({c: F.bround(F.col(c), n) for c, n in digits.items()})


def population_pyramid(df: DataFrame, estimates: DataFrame, year: int = REPORT_YEAR,
                       recode: dict[str, str] | None = None,
                       merge=(("Asian alone", "Native Hawaiian and Other Pacific Islander alone"),
                              "Asian or Pacific Islander"),
                       origin_label: str | None = None,
                       exclude=EXCLUDED_RACES) -> dict[str, DataFrame]:
    """Case population of ``year`` against the population estimates."""
    reference = pop.reference_population(estimates, recode=recode, merge=merge,
                                         origin_label=origin_label)
    cases = pop.relabel_case_ages(pop.case_population(df, year, exclude),
                                  old_bands=pop.OLD_AGES)
    pyramid = pop.population_compare(reference, cases)
    composition = pop.group_composition(pyramid)
    return {"pyramid": pyramid, "composition": composition,
            "pyramid_display": rounded(pyramid, {"Proportion": 2}),
            "composition_display": rounded(composition, {"Proportion": 2}),
            "actual_vs_expected": pop.actual_vs_expected(pyramid)}


def pretrial_questions(df: DataFrame, periods=STAY_PERIODS, rate: int = 82,
                       warrant: str = "WARRANT", anchor: str = DRUGS) -> dict[str, DataFrame]:
    """The follow-up questions: stay length, booking-days cost, daily
    headcount, combinations with the anchor group, warrants, initial vs
    final charges."""
    from snapcase.operators import charges as ch
    from snapcase.operators import stays as st
    stays = st.episode_stays(df)
    return {
        "days": st.pretrial_days(df, stays),
        "cost": st.booking_days_cost(df, periods, rate, stays),
        "headcount": st.daily_pretrial_headcount(df),
        "combinations": ch.group_combinations_by_race(df, anchor),
        "warrants": ch.warrant_share(df, warrant),
        "initial_final": st.initial_and_final_charges(df),
    }


__all__ = ["fiscal_profile", "monthly_profile", "association", "population_pyramid",
           "pretrial_questions", "CHARGE_CORRECTIONS", "FISCAL_PERIODS",
           "STAY_PERIODS"]
