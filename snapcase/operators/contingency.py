"""Episode flags and stratified 2x2x2 tables.

Each episode of the two compared races gets Yes/No flags for the drug,
traffic and other groups.  The three-way table (race x outcome x given)
is kept as eight conditional sums per stratum -- one aggregation pass, no
join, no zero-fill step -- and exploded to long form only for output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcase.functions.stats import Z_975, log_or_se
from snapcase.operators.episodes import BOOKING

YES, NO = "Yes", "No"


def rescue_group(group: Column, charge: Column, pattern: str | None, target: str) -> Column:
    """NULL group whose charge text contains ``pattern`` becomes ``target``."""
    if not pattern:
        return group
    return F.when(group.isNull() & charge.contains(pattern), F.lit(target)).otherwise(group)


def collapse_group(group: Column, keep: Sequence[str], other: str = "Other") -> Column:
    """Groups outside ``keep`` become ``other``; NULL stays NULL."""
    return F.when(group.isin(list(keep)), group) \
            .when(group.isNotNull(), F.lit(other))


def episode_flags(df: DataFrame, drug: str = "DRUGS", traffic: str = "TRAFFIC",
                  races: Sequence[str] = ("Black-origins of Africa", "White/Eurp/ N.Afr/Mid Eas"),
                  rescue_pattern: str | None = "POSS CONT SUB", keys: Sequence[str] = BOOKING,
                  race_col: str = "RaceDescription", group_col: str = "ChargeGroup",
                  charge_col: str = "Charge", strata: Sequence[str] = ()) -> DataFrame:
    """One row per (episode, race) with Yes/No flags.

    Output: ``keys, strata, race, drugs, traffic, other``.  Episodes whose
    charges all have a NULL group (after the rescue) are absent.
    """
    g = collapse_group(rescue_group(F.col(group_col), F.col(charge_col), rescue_pattern, drug),
                       [drug, traffic])
    rows = (df.filter(F.col(race_col).isin(list(races)))
              .select(*keys, *strata, F.col(race_col).alias("race"), g.alias("_g"))
              .filter(F.col("_g").isNotNull()))

    def flag(value: str) -> Column:
        return F.when(F.max((F.col("_g") == value).cast("int")) == 1, F.lit(YES)).otherwise(F.lit(NO))

    return rows.groupBy(*keys, *strata, "race").agg(
        flag(drug).alias("drugs"), flag(traffic).alias("traffic"), flag("Other").alias("other"))


def freq_table(flags: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    """Frequency of each flag combination by race."""
    return flags.groupBy(*strata, "race", "traffic", "drugs", "other") \
                .agg(F.count(F.lit(1)).alias("freq"))


def _cell(race: str, d: str, t: str) -> str:
    return f"c_{race}_{d}_{t}"


def cell_sums(flags: DataFrame, races: Sequence[str], strata: Sequence[str] = ()) -> DataFrame:
    """Eight counts per stratum: race (2) x drugs (Yes/No) x traffic (Yes/No).

    Columns ``c_<r>_<d>_<t>`` with r in {0,1} (order of ``races``) and d, t in
    {0: No, 1: Yes}; the "other" flag is summed over (marginalised).
    """
    aggs = []
    for r, race in enumerate(races):
        for d, dv in enumerate((NO, YES)):
            for t, tv in enumerate((NO, YES)):
                cond = (F.col("race") == race) & (F.col("drugs") == dv) & (F.col("traffic") == tv)
                aggs.append(F.count(F.when(cond, 1)).alias(_cell(r, d, t)))
    return flags.groupBy(*strata).agg(*aggs)


def xtab3(flags: DataFrame, races: Sequence[str], strata: Sequence[str] = (),
          outcome: str = "drugs") -> DataFrame:
    """Zero-filled race x outcome x given table in long form.

    ``outcome`` is ``drugs`` (given traffic) or ``traffic`` (given drugs).
    Level order, as sort columns: races as given, outcome Yes before No
    (reversed), given No before Yes.
    """
    given = "traffic" if outcome == "drugs" else "drugs"
    cells = cell_sums(flags, races, strata)
    structs = []
    for r, race in enumerate(races):
        for o, ov in enumerate((YES, NO)):
            for gi, gv in enumerate((NO, YES)):
                d, t = ((1 - o, gi) if outcome == "drugs" else (gi, 1 - o))
                structs.append(F.struct(F.lit(race).alias("race"), F.lit(ov).alias(outcome),
                                        F.lit(gv).alias(given),
                                        F.col(_cell(r, d, t)).cast("long").alias("freq"),
                                        F.lit(r * 4 + o * 2 + gi).alias("cell_order")))
    return cells.select(*strata, F.inline(F.array(*structs)))


def flat_table(flags: DataFrame, races: Sequence[str], strata: Sequence[str] = ()) -> DataFrame:
    """Printable cross table: rows race x drugs, one column per traffic level."""
    long = xtab3(flags, races, strata, "drugs")
    return (long.groupBy(*strata, "race", "drugs")
                .agg(F.sum(F.when(F.col("traffic") == NO, F.col("freq"))).cast("long")
                      .alias("traffic_no"),
                     F.sum(F.when(F.col("traffic") == YES, F.col("freq"))).cast("long")
                      .alias("traffic_yes")))


def conditional_odds_ratio(flags: DataFrame, races: Sequence[str], strata: Sequence[str] = (),
                           level: float = 0.95) -> DataFrame:
    """Odds ratios of the outcome (first race vs second) per level of the
    given flag, both orientations, with Wald intervals (C26, C27).

    OR | g = n(r1,Yes,g) n(r2,No,g) / (n(r1,No,g) n(r2,Yes,g)).  When any of
    the eight cells of a stratum is zero, 0.5 is added to all of them.  The
    interval is exp(log OR +- z sqrt(sum 1/n)); ``contains_one`` flags
    intervals that include 1.
    """
    if level != 0.95:
        raise ValueError("only the 95% interval is built in")
    cells = cell_sums(flags, races, strata)
    names = [_cell(r, d, t) for r in (0, 1) for d in (0, 1) for t in (0, 1)]
    any_zero = F.greatest(*[(F.col(c) == 0).cast("int") for c in names]) == 1
    # Staged projections (adjusted cells, then log odds and error, then the
    # interval) keep each generated expression small.
    cells = cells.withColumn("_adj", F.when(any_zero, F.lit(0.5)).otherwise(F.lit(0.0)))
    cells = cells.withColumns({f"a_{c}": F.col(c).cast("double") + F.col("_adj") for c in names})
    specs = []
    for outcome in ("drugs", "traffic"):
        for gi, gv in enumerate((NO, YES)):
            def n(r, o_yes):
                d, t = ((o_yes, gi) if outcome == "drugs" else (gi, o_yes))
                return F.col(f"a_{_cell(r, d, t)}")
            specs.append((outcome, gi, gv, n(0, 1), n(0, 0), n(1, 1), n(1, 0)))
    stage = {}
    for outcome, gi, _, a, b, c, d_ in specs:
        stage[f"lor_{outcome}_{gi}"] = F.log(a) + F.log(d_) - F.log(b) - F.log(c)
        stage[f"se_{outcome}_{gi}"] = log_or_se([a, b, c, d_])
        stage[f"or_{outcome}_{gi}"] = (a * d_) / (b * c)
    cells = cells.withColumns(stage)
    rows = []
    for outcome, gi, gv, *_ in specs:
        log_or, se = F.col(f"lor_{outcome}_{gi}"), F.col(f"se_{outcome}_{gi}")
        rows.append(F.struct(
            F.lit(f"{outcome}|{'traffic' if outcome == 'drugs' else 'drugs'}").alias("orientation"),
            F.lit(gv).alias("given_level"),
            F.col(f"or_{outcome}_{gi}").alias("odds_ratio"),
            log_or.alias("log_or"),
            se.alias("ase"),
            F.exp(log_or - F.lit(Z_975) * se).alias("lwr"),
            F.exp(log_or + F.lit(Z_975) * se).alias("upr")))
    out = cells.select(*strata, F.inline(F.array(*rows)))
    return out.withColumn("contains_one", (F.col("lwr") <= 1.0) & (F.col("upr") >= 1.0))
