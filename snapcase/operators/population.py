"""Case population vs reference population.

Reference side: estimates filtered to detail rows, race labels recoded,
categories merged or built from another dimension.  Case side: pre-trial
episodes of a year, counted by race x gender x age with every observed
combination present.  Both sides meet in a 3-key inner join, become long
(population, value) rows and get within-race shares (pyramid data).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapcase.functions.bins import cut_bins, interval_to_range_label
from snapcase.operators.episodes import BOOKING, TS, first_per_group, pretrial_rowlevel
from snapcase.operators.grid import combinations
from snapcase.operators.recode import recode_values
from snapcase.session import shared_dir

# Detail filters and race labels of the published comparison.
DROP_AGES = ("All ages", "Age 0 to 4 years", "Age 5 to 9 years", "Age 10 to 14 years",
             "Age 15 to 19 years")
DROP_RACES = ("All races", "Two or more races", "White alone or in combination",
              "Black alone or in combination",
              "American Indian and Alaska Native alone or in combination",
              "Asian alone or in combination",
              "Native Hawaiian and Other Pacific Islander alone or in combination")
RACE_RECODE = {"American Indian and Alaska Native alone": "Amer Indian/Alaska Native",
               "Black alone": "Black-origins of Africa",
               "White alone": "White/Eurp/ N.Afr/Mid Eas"}
ALL_SEXES = "Both sexes"
GENDER_NAMES = {"M": "Male", "F": "Female"}
CASE_EXCLUDED_RACES = ("Other", "UNKNOWN")
# The 85+ band of the published figure, and the band list it should have used.
OLD_AGES_PUBLISHED = ("85 to 89", "95 to 99")
OLD_AGES = ("85 to 89", "90 to 94", "95 to 99")


def not_in(col: Column, values: Sequence[str]) -> Column:
    """``!x %in% set``: TRUE for NULL ``x`` too."""
    return col.isNull() | ~col.isin(list(values))


def population_filter(pop: DataFrame, origin: str = "Non-Hispanic",
                      drop_ages: Sequence[str] = DROP_AGES,
                      drop_races: Sequence[str] = DROP_RACES,
                      recode: dict[str, str] | None = None, value_name: str = "ref_count") -> DataFrame:
    """Detail rows of one origin, race labels recoded.

    Output: ``Race, Age, Gender, <value_name>``.
    """
    recode = RACE_RECODE if recode is None else recode
    rows = pop.filter((F.col("HISP") == origin) & not_in(F.col("AGEGROUP"), drop_ages)
                      & not_in(F.col("RACE"), drop_races) & (F.col("SEX") != ALL_SEXES))
    return rows.select(recode_values(F.col("RACE"), recode).alias("Race"),
                       F.col("AGEGROUP").alias("Age"), F.col("SEX").alias("Gender"),
                       F.col("value").alias(value_name))


def merge_categories(df: DataFrame, col: str, members: Sequence[str], label: str,
                     value: str) -> DataFrame:
    """Replace the rows of ``members`` by one summed row labelled ``label``
    per combination of the other key columns (C29)."""
    keys = [c for c in df.columns if c not in (col, value)]
    merged = (df.filter(F.col(col).isin(list(members)))
                .groupBy(*keys).agg(F.sum(value).cast("long").alias(value))
                .withColumn(col, F.lit(label)))
    return df.filter(not_in(F.col(col), members)).unionByName(merged)


def marginal_category(pop: DataFrame, origin: str = "Hispanic", label: str | None = None,
                      drop_ages: Sequence[str] = DROP_AGES,
                      drop_races: Sequence[str] = DROP_RACES,
                      value_name: str = "ref_count") -> DataFrame:
    """A race-like category built from the origin dimension: detail rows of
    ``origin`` summed over race per (age, gender) (C30)."""
    rows = pop.filter((F.col("HISP") == origin) & not_in(F.col("AGEGROUP"), drop_ages)
                      & not_in(F.col("RACE"), drop_races) & (F.col("SEX") != ALL_SEXES))
    return (rows.groupBy(F.col("AGEGROUP").alias("Age"), F.col("SEX").alias("Gender"))
                .agg(F.sum("value").cast("long").alias(value_name))
                .withColumn("Race", F.lit(label or origin))
                .select("Race", "Age", "Gender", value_name))


def reference_population(pop: DataFrame, recode: dict[str, str] | None = None,
                         merge: tuple[Sequence[str], str] = (("Asian alone",
                         "Native Hawaiian and Other Pacific Islander alone"),
                         "Asian or Pacific Islander"),
                         origin_label: str | None = None) -> DataFrame:
    """C28 + C29 + C30, ages relabelled ``Age 20 to 24 years`` -> ``20 to 24``."""
    detail = population_filter(pop, recode=recode)
    merged = merge_categories(detail, "Race", merge[0], merge[1], "ref_count")
    out = merged.unionByName(marginal_category(pop, label=origin_label))
    return out.withColumn("Age", F.regexp_replace("Age", "Age | years", ""))


def count_complete(df: DataFrame, dims: Sequence[str], name: str = "n") -> DataFrame:
    """Counts by ``dims`` with every combination of observed levels present
    (zeros filled) (C31).

    The levels are distinct values of the aggregated counts and are combined
    one dimension after the other.  A NULL level is a level of its own,
    matched null-safe.
    """
    dims = list(dims)
    # The aggregated counts feed the level lists and the final join: checkpoint
    # them (small) so the upstream chain runs once.
    shared_dir(df.sparkSession)
    counts = df.groupBy(*dims).agg(F.count(F.lit(1)).alias(name)).checkpoint(eager=True)
    grid = counts.select(dims[0]).distinct()
    for d in dims[1:]:
        grid = combinations(grid, counts.select(d).distinct())
    c = counts.select(*[F.col(d).alias(f"_{d}") for d in dims], name)
    cond = None
    for d in dims:
        eq = F.col(d).eqNullSafe(F.col(f"_{d}"))
        cond = eq if cond is None else cond & eq
    return (grid.join(c, cond, "left")
                .select(*dims, F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)))


def case_population(df: DataFrame, year: int, exclude: Sequence[str] = CASE_EXCLUDED_RACES,
                    width: int = 5) -> DataFrame:
    """Pre-trial episodes (row-level rule) of ``year``: first row's race,
    gender and ``width``-year age band, all combinations counted (C31 input)."""
    rows = pretrial_rowlevel(df, year).filter(not_in(F.col("RaceDescription"), exclude))
    rows = rows.withColumn("age_band", cut_bins(F.col("CurrentAge"), 0, 100, width))
    first = first_per_group(rows, BOOKING, [TS], ["RaceDescription", "Gender", "age_band"])
    return count_complete(first.select(F.col("RaceDescription").alias("Race"),
                                       F.col("Gender"), F.col("age_band").alias("Age")),
                          ["Race", "Gender", "Age"])


def relabel_case_ages(counts: DataFrame, drop_band: str = "15 to 19",
                      old_bands: Sequence[str] = OLD_AGES, old_label: str = "85 and older",
                      genders: dict[str, str] | None = None) -> DataFrame:
    """Interval labels -> ``20 to 24``, one band dropped, old bands merged,
    gender codes spelled out.  Output ``Race, Gender, Age, case_count``."""
    genders = GENDER_NAMES if genders is None else genders
    out = counts.withColumn("Age", interval_to_range_label(F.col("Age")))
    out = out.filter(F.col("Age") != drop_band).withColumnRenamed("n", "case_count")
    out = merge_categories(out.select("Race", "Gender", "Age", "case_count"), "Age", old_bands,
                           old_label, "case_count")
    return out.withColumn("Gender", recode_values(F.col("Gender"), genders))


def population_compare(reference: DataFrame, cases: DataFrame) -> DataFrame:
    """Pyramid data (C33): joined on (Age, Gender, Race), one row per
    population, ``Proportion`` = 100 * value / race total of that population;
    male values negated."""
    joined = reference.join(cases, ["Age", "Gender", "Race"], "inner")
    long = joined.select("Age", "Gender", "Race", F.col("ref_count").alias("reference"),
                         F.col("case_count").alias("cases")) \
                 .unpivot(["Age", "Gender", "Race"], ["reference", "cases"], "Group", "Value")
    w = Window.partitionBy("Race", "Group")
    total = F.sum("Value").over(w)
    long = long.withColumn("Total", total.cast("long")) \
               .withColumn("Proportion", F.try_divide(F.lit(100.0) * F.col("Value").cast("double"),
                                                      F.col("Total").cast("double")))
    male = F.col("Gender") == "Male"
    return long.select(
        "Age", "Gender", "Race", "Group",
        F.when(male, -F.col("Value")).otherwise(F.col("Value")).cast("long").alias("Value"),
        "Total",
        F.when(male, -F.col("Proportion")).otherwise(F.col("Proportion")).alias("Proportion"))


def group_composition(pyramid: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Race share of each population in percent."""
    labels = ({"reference": "Reference population", "cases": "Case population"}
              if labels is None else labels)
    per_race = pyramid.groupBy("Race", "Group").agg(
        F.sum(F.abs(F.col("Value"))).cast("long").alias("Total"))
    w = Window.partitionBy("Group")
    return per_race.select(
        "Race", recode_values(F.col("Group"), labels).alias("Group"), "Total",
        F.try_divide(F.lit(100.0) * F.col("Total").cast("double"),
                     F.sum("Total").over(w).cast("double")).alias("Proportion"))


def actual_vs_expected(pyramid: DataFrame, observed: str = "cases",
                       reference: str = "reference") -> DataFrame:
    """Observed case counts per race against the count expected from the
    reference population's race shares (Q04)."""
    per_race = pyramid.groupBy("Race").agg(
        F.sum(F.when(F.col("Group") == observed, F.abs("Value"))).cast("long").alias("observed"),
        F.sum(F.when(F.col("Group") == reference, F.abs("Value"))).cast("long").alias("ref"))
    # One row per race: a window over the whole (tiny) table gives the totals
    # without re-running the two populations for a scalar subquery.
    w = Window.partitionBy()
    share = F.try_divide(F.col("ref").cast("double"), F.sum("ref").over(w).cast("double"))
    expected = F.sum("observed").over(w).cast("double") * share
    return per_race.select("Race", "observed", share.alias("reference_share"),
                           expected.alias("expected")) \
                   .withColumn("difference", F.col("observed") - F.col("expected")) \
                   .withColumn("ratio", F.try_divide(F.col("observed"), F.col("expected")))
