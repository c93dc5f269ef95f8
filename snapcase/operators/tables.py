"""General contingency tables: sparse r x c association (C16, C17) and log-linear models
over any number of factors and levels (C25)."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapcase.functions.stats import chisq_upper_p_any
from snapcase.session import shared_dir

# A fit ends when no cell moves by more than this share of it; cycles of one job, and at most.
TOLERANCE = 1e-12
CYCLES_OF_A_JOB = 4
MOST_CYCLES = 4000


def association_table(df: DataFrame, a: str, b: str, strata: Sequence[str] = ()) -> DataFrame:
    """Chi-square and Cramér's V of two columns of any number of levels, per stratum.

    Only cells that occur are formed: an empty cell adds its expectation, so all of them
    together add n less the expectations of the others.  Rows with a NULL level are left out.
    A table of 2 x 2 gets the continuity correction.  V is NULL where a side has one level.
    Output: ``strata, n, rows, cols, df, chi2, p_value, cramers_v``.
    """
    strata = list(strata)
    cells = (df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
             .groupBy(*strata, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n")))
    w_a, w_b, w_all = (Window.partitionBy(*strata, *c) for c in (["_a"], ["_b"], []))
    total = F.sum("_n").over(w_all).cast("double")
    expected = F.sum("_n").over(w_a).cast("double") * F.sum("_n").over(w_b).cast("double") / total
    cells = cells.withColumn("_e", expected)
    off = F.col("_n").cast("double") - F.col("_e")
    out = cells.groupBy(*strata).agg(
        F.sum("_n").alias("n"), F.count_distinct("_a").alias("rows"), F.count_distinct("_b").alias("cols"),
        F.sum(off * off / F.col("_e")).alias("_s"), F.sum("_e").alias("_seen"), F.max(F.abs(off)).alias("_d"))
    n = F.col("n").cast("double")
    plain = F.col("_s") + F.greatest(F.lit(0.0), n - F.col("_seen"))
    # All cells of a 2 x 2 table are off by the same amount.
    left = (F.col("_d") - F.least(F.col("_d"), F.lit(0.5))) / F.col("_d")
    corrected = F.when(F.col("_d") > 0, plain * left * left).otherwise(plain)
    small = F.least("rows", "cols")
    out = out.filter("n > 0").withColumn("df", (F.col("rows") - 1) * (F.col("cols") - 1)).withColumn(
        "chi2", F.when((F.col("rows") == 2) & (F.col("cols") == 2), corrected).otherwise(plain))
    return out.select(
        *strata, "n", "rows", "cols", "df", "chi2",
        F.when(F.col("df") > 0, chisq_upper_p_any(F.col("chi2"), F.col("df"))).alias("p_value"),
        F.when(small > 1, F.sqrt(F.col("chi2") / (n * (small - 1).cast("double")))).alias("cramers_v"))


def _key(columns: Sequence[str]) -> Column:
    """One text for the levels of some factors; levels hold no unit separator."""
    return F.concat_ws("\x1f", *[F.col(c) for c in columns]) if columns else F.lit("")


def table_cells(df: DataFrame, factors: Sequence[str], strata: Sequence[str] = ()) -> DataFrame:
    """The cross table of the factors, empty cells as well: strata, factors (as text), n.

    Levels are those that a stratum's rows hold; rows with a NULL level are left out.
    """
    factors, strata = list(factors), list(strata)
    given = df
    for f in factors:
        given = given.filter(F.col(f).isNotNull())
    # NULL strata are strata of their own.
    name = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), F.col(s).cast("string")), F.lit("n"))
                                 for s in strata]) if strata else F.lit("")
    counts = given.groupBy(*strata, name.alias("_s"), *[F.col(f).cast("string").alias(f) for f in factors]).agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    shared_dir(df.sparkSession)
    counts = counts.checkpoint()
    # The grid is the table itself: its size is the product of a stratum's levels.
    grid = counts.select(*strata, "_s").distinct()
    for f in factors:
        grid = grid.join(counts.select("_s", f).distinct(), "_s")
    return grid.join(counts.select("_s", *factors, "n"), ["_s", *factors], "left").fillna(0.0, ["n"])


def fitted_cells(df: DataFrame, factors: Sequence[str], models: Mapping[str, Sequence[Sequence[str]]],
                 strata: Sequence[str] = ()) -> DataFrame:
    """The cross table with the fit of each model: strata, factors, model, n, m.

    Proportional fitting over the long table: a step scales every cell by the ratio of the
    observed to the fitted sum of its margin, a window over that margin's cells; all models
    and strata take their steps together.  A few cycles make one job, whose result is
    checkpointed; the fit ends when a cycle moves no cell by more than ``TOLERANCE`` of it.
    """
    cells = table_cells(df, factors, strata)
    names = F.array(*[F.lit(m) for m in models])
    state = cells.withColumn("model", F.explode(names)).withColumns({"m": F.lit(1.0), "_moved": F.lit(1.0)})
    depth = max(len(margins) for margins in models.values())
    for step in range(depth):
        key = None
        for model, margins in models.items():
            # A model with fewer margins repeats its last one, which then changes nothing.
            own = _key(list(margins[min(step, len(margins) - 1)]))
            key = F.when(F.col("model") == model, own) if key is None else key.when(F.col("model") == model, own)
        state = state.withColumn(f"_k{step}", key)
    for _ in range(-(-MOST_CYCLES // CYCLES_OF_A_JOB)):
        for _ in range(CYCLES_OF_A_JOB):
            state = state.withColumn("_before", F.col("m"))
            for step in range(depth):
                margin = Window.partitionBy("_s", "model", f"_k{step}")
                now = F.sum("m").over(margin)
                state = state.withColumn("m", F.when(now > 0, F.col("m") * F.sum("n").over(margin) / now)
                                         .otherwise(F.lit(0.0)))
            state = state.withColumn("_moved", F.when(F.col("m") > 0, F.abs(F.col("m") - F.col("_before"))
                                                      / F.col("m")).otherwise(0.0))
        state = state.drop("_before").checkpoint()
        if (state.agg(F.max("_moved")).first()[0] or 0.0) <= TOLERANCE:
            return state.select(*strata, "_s", *factors, "model", "n", "m")
    raise RuntimeError("the fit did not settle")


def loglinear_models(df: DataFrame, factors: Sequence[str], models: Mapping[str, Sequence[Sequence[str]]],
                     strata: Sequence[str] = ()) -> DataFrame:
    """Log-linear models of the cross table of ``factors``, each given by the margins it keeps.

    Any number of factors and levels.  A cell on an empty margin is fitted as 0, degrees of
    freedom are those of the full table.  Output: ``strata, model, df, g2, x2, p_g2, p_x2``.
    """
    strata, factors = list(strata), list(factors)
    cells = fitted_cells(df, factors, models, strata)
    n, m = F.col("n"), F.col("m")
    out = cells.groupBy(*strata, "_s", "model").agg(
        F.sum(F.when((n > 0) & (m > 0), n * F.log(n / m)).otherwise(0.0)).alias("_g"),
        F.sum(F.when(m > 0, (n - m) * (n - m) / m).otherwise(0.0)).alias("x2"),
        F.count(F.lit(1)).alias("_cells"), *[F.count_distinct(f).alias(f"_l_{f}") for f in factors])
    left = None
    for model, margins in models.items():
        terms = {frozenset(s) for keep in margins for k in range(len(keep) + 1)
                 for s in itertools.combinations(keep, k)}
        used = F.lit(0).cast("long")
        for term in terms:
            size = F.lit(1).cast("long")
            for f in sorted(term):
                size = size * (F.col(f"_l_{f}") - 1)
            used = used + size
        free = F.col("_cells") - used
        left = F.when(F.col("model") == model, free) if left is None else left.when(F.col("model") == model, free)
    out = out.withColumn("df", left).withColumn("g2", F.greatest(F.lit(0.0), F.col("_g") * 2))
    return out.select(*strata, "model", "df", "g2", "x2",
                      chisq_upper_p_any(F.col("g2"), F.col("df")).alias("p_g2"),
                      chisq_upper_p_any(F.col("x2"), F.col("df")).alias("p_x2"))


def standard_models(race: str = "race", drugs: str = "drugs", traffic: str = "traffic") -> dict:
    """The six models of the published report, for any number of races."""
    return {"independence": [[race], [drugs], [traffic]],
            "joint_dt_r": [[drugs, traffic], [race]],
            "conditional_dt_dr": [[drugs, traffic], [drugs, race]],
            "conditional_dt_tr": [[drugs, traffic], [traffic, race]],
            "homogeneous": [[drugs, traffic], [drugs, race], [traffic, race]],
            "saturated": [[drugs, traffic, race]]}
