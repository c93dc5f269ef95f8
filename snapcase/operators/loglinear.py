"""Log-linear models of the race x drugs x traffic table.

Six hierarchical models, per stratum, from the eight cell counts of
:func:`snapcase.operators.contingency.cell_sums`.  Five have closed-form
fitted values.  The homogeneous-association model (DT, DR, TR) keeps all
two-way margins, so its fitted cells differ from the counts by one number
``shift``, added to the cells of even index sum and taken from the others; it
is the root at which both groups of four cells have the same product.  That
difference grows with ``shift``, so the root is found by bisection down to
neighbouring doubles, as a fold inside the row of the stratum.

A fitted value is 0 where a margin that it is made of is 0; such cells add
nothing to the statistics.  Degrees of freedom stay those of the full table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcase.functions.stats import chisq_upper_p_by_df
from snapcase.operators.contingency import _cell, cell_sums

# Model name, degrees of freedom (2x2x2 table).
MODELS = (("independence", 4), ("joint_dt_r", 3), ("conditional_dt_dr", 2),
          ("conditional_dt_tr", 2), ("homogeneous", 1), ("saturated", 0))

CELLS = [(r, d, t) for r in (0, 1) for d in (0, 1) for t in (0, 1)]


def _div(a: Column, b: Column) -> Column:
    """Division that yields 0 for an empty margin, whose cells are all 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _n(r, d, t) -> Column:
    return F.col(f"n_{r}_{d}_{t}")


def _sum(cols: list[Column]) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total


def _with_margins(cells: DataFrame) -> DataFrame:
    """Cells as doubles, then every margin as its own column.

    Each stage is a separate projection so the model expressions refer to
    columns instead of re-expanding the sums (keeps generated code small).
    """
    df = cells.withColumns({f"n_{r}_{d}_{t}": F.col(_cell(r, d, t)).cast("double")
                            for (r, d, t) in CELLS})
    n = {k: _n(*k) for k in CELLS}
    m1 = {"N": _sum([n[k] for k in CELLS])}
    m1.update({f"dt_{d}_{t}": n[(0, d, t)] + n[(1, d, t)] for d in (0, 1) for t in (0, 1)})
    m1.update({f"rd_{r}_{d}": n[(r, d, 0)] + n[(r, d, 1)] for r in (0, 1) for d in (0, 1)})
    m1.update({f"rt_{r}_{t}": n[(r, 0, t)] + n[(r, 1, t)] for r in (0, 1) for t in (0, 1)})
    df = df.withColumns(m1)
    m2 = {f"r_{r}": F.col(f"rd_{r}_0") + F.col(f"rd_{r}_1") for r in (0, 1)}
    m2.update({f"d_{d}": F.col(f"dt_{d}_0") + F.col(f"dt_{d}_1") for d in (0, 1)})
    m2.update({f"t_{t}": F.col(f"dt_0_{t}") + F.col(f"dt_1_{t}") for t in (0, 1)})
    return df.withColumns(m2)


def _margins():
    n = {k: _n(*k) for k in CELLS}
    N = F.col("N")
    dt = {(d, t): F.col(f"dt_{d}_{t}") for d in (0, 1) for t in (0, 1)}
    rd = {(r, d): F.col(f"rd_{r}_{d}") for r in (0, 1) for d in (0, 1)}
    rt = {(r, t): F.col(f"rt_{r}_{t}") for r in (0, 1) for t in (0, 1)}
    r1 = {r: F.col(f"r_{r}") for r in (0, 1)}
    d1 = {d: F.col(f"d_{d}") for d in (0, 1)}
    t1 = {t: F.col(f"t_{t}") for t in (0, 1)}
    return n, N, dt, rd, rt, r1, d1, t1


# Halvings after which any interval of doubles has shrunk to neighbours.
HALVINGS = 1100


def homogeneous_shift(n) -> Column:
    """The shift of the homogeneous fit, from the cell counts ``n``."""
    even = [n[k] for k in CELLS if sum(k) % 2 == 0]
    odd = [n[k] for k in CELLS if sum(k) % 2 == 1]

    def product(cells: list[Column], by: Column) -> Column:
        return (cells[0] + by) * (cells[1] + by) * (cells[2] + by) * (cells[3] + by)

    def halve(span: Column, _: Column) -> Column:
        middle = (span["lo"] + span["hi"]) / 2
        high = product(even, middle) > product(odd, -middle)
        return F.struct(F.when(high, span["lo"]).otherwise(middle).alias("lo"),
                        F.when(high, middle).otherwise(span["hi"]).alias("hi"))

    start = F.struct((-F.least(*even)).alias("lo"), F.least(*odd).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve,
                       lambda span: (span["lo"] + span["hi"]) / 2)


def loglinear_fit(flags: DataFrame, races: Sequence[str], strata: Sequence[str] = ()) -> DataFrame:
    """G2, Pearson X2, df and upper-tail p for the six models, per stratum.

    Output: ``strata, model, df, g2, x2, p_g2, p_x2``.  The table goes long
    first -- one row per (stratum, model) holding the observed and fitted
    cells as arrays -- so each statistic is one expression, not one per model.
    """
    cells = _with_margins(cell_sums(flags, races, strata))
    n, N, dt, rd, rt, r1, d1, t1 = _margins()
    closed = {
        "independence": [_div(r1[r] * d1[d] * t1[t], N * N) for (r, d, t) in CELLS],
        "joint_dt_r": [_div(dt[(d, t)] * r1[r], N) for (r, d, t) in CELLS],
        "conditional_dt_dr": [_div(dt[(d, t)] * rd[(r, d)], d1[d]) for (r, d, t) in CELLS],
        "conditional_dt_tr": [_div(dt[(d, t)] * rt[(r, t)], t1[t]) for (r, d, t) in CELLS],
        "saturated": [n[k] for k in CELLS],
    }
    shift = F.col("_shift")
    staged = cells.withColumn("_shift", homogeneous_shift(n)).withColumn("_homog", F.array(
        *[n[k] - shift if sum(k) % 2 else n[k] + shift for k in CELLS]))
    models = []
    for name, df_ in MODELS:
        fitted = F.col("_homog") if name == "homogeneous" else F.array(*closed[name])
        models.append(F.struct(F.lit(name).alias("model"), F.lit(df_).alias("df"),
                               fitted.alias("_fit")))
    long = staged.select(*strata, F.array(*[n[k] for k in CELLS]).alias("_obs"),
                         F.inline(F.array(*models)))
    g2 = F.aggregate(F.zip_with("_obs", "_fit", lambda o, f: F.when(
        o > 0, o * F.log(_div(o, f))).otherwise(F.lit(0.0))), F.lit(0.0),
        lambda a, b: a + b) * F.lit(2.0)
    g2 = F.greatest(g2, F.lit(0.0))
    x2 = F.aggregate(F.zip_with("_obs", "_fit", lambda o, f: _div((o - f) * (o - f), f)),
                     F.lit(0.0), lambda a, b: a + b)
    stats = long.select(*strata, "model", "df", g2.alias("g2"), x2.alias("x2"))
    return stats.select(*strata, "model", "df", "g2", "x2",
                        chisq_upper_p_by_df(F.col("g2"), F.col("df")).alias("p_g2"),
                        chisq_upper_p_by_df(F.col("x2"), F.col("df")).alias("p_x2"))
