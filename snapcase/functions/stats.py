"""Statistical column expressions: 2x2 chi-square, p-values, Wald intervals.

Upper-tail chi-square probabilities use the regularized incomplete gamma
function Q(1/2, z): its power series below z = 1.5 and Lentz's continued
fraction above (the textbook pair, e.g. Numerical Recipes ``gser``/``gcf``),
each a fixed-length ``aggregate`` fold inside the row -- constant plan size,
relative error ~1e-13.  Significance decisions do not use them at all: they
compare the statistic with the exact 0.95 quantile of chi-square(1).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# 0.95 quantile of chi-square with one degree of freedom and the
# 0.975 standard-normal quantile.
CHISQ1_95 = 3.841458820694124
Z_975 = 1.959963984540054

GAMMA_STEPS = 60
FPMIN = 1e-300


def _lit(v: float) -> Column:
    return F.lit(float(v))


def _guard(x: Column) -> Column:
    return F.when(F.abs(x) < _lit(FPMIN), _lit(FPMIN)).otherwise(x)


def gamma_q_half(z: Column) -> Column:
    """Q(1/2, z) = erfc(sqrt(z)) for ``z >= 0``."""
    pre = F.sqrt(z) * F.exp(-z) / _lit(math.sqrt(math.pi))
    steps = F.sequence(F.lit(1), F.lit(GAMMA_STEPS))
    series = F.aggregate(
        steps, F.struct(_lit(0.5).alias("ap"), _lit(2.0).alias("de"), _lit(2.0).alias("s")),
        lambda acc, i: F.struct((acc["ap"] + 1.0).alias("ap"),
                                (acc["de"] * z / (acc["ap"] + 1.0)).alias("de"),
                                (acc["s"] + acc["de"] * z / (acc["ap"] + 1.0)).alias("s")))

    def cf_step(acc, i):
        an = -(i * (i - 0.5))
        b2 = acc["b"] + 2.0
        d = _guard(an * acc["d"] + b2)
        c = _guard(b2 + an / acc["c"])
        return F.struct(b2.alias("b"), c.alias("c"), (_lit(1.0) / d).alias("d"),
                        (acc["h"] * (_lit(1.0) / d) * c).alias("h"))

    b0 = z + 0.5
    cf = F.aggregate(steps, F.struct(b0.alias("b"), _lit(1.0 / FPMIN).alias("c"),
                                     (_lit(1.0) / b0).alias("d"), (_lit(1.0) / b0).alias("h")),
                     cf_step)
    return F.when(z < _lit(1.5), _lit(1.0) - series["s"] * pre).otherwise(pre * cf["h"])


def _unit(p: Column) -> Column:
    """Clamp rounding overshoot above 1 (NULL stays NULL)."""
    return F.when(p > _lit(1.0), _lit(1.0)).otherwise(p)


def chisq_upper_p(x: Column, df: int) -> Column:
    """P(X > x) for chi-square with 0..4 degrees of freedom (closed forms)."""
    half = x / _lit(2.0)
    if df == 0:
        return _lit(1.0)
    if df == 1:
        return _unit(gamma_q_half(half))
    if df == 2:
        return F.exp(-half)
    if df == 3:
        return _unit(gamma_q_half(half) + F.sqrt(_lit(2.0) * x / _lit(math.pi)) * F.exp(-half))
    if df == 4:
        return F.exp(-half) * (_lit(1.0) + half)
    raise ValueError("closed forms exist for df 0..4 only")


def chisq_upper_p_by_df(x: Column, df: Column) -> Column:
    """:func:`chisq_upper_p` with the degrees of freedom (0..4) in a column.

    The incomplete-gamma fold is built once and shared by df 1 and df 3.
    """
    half = x / _lit(2.0)
    q = gamma_q_half(half)
    e = F.exp(-half)
    return (F.when(df == 0, _lit(1.0))
             .when(df == 1, _unit(q))
             .when(df == 2, e)
             .when(df == 3, _unit(q + F.sqrt(_lit(2.0) * x / _lit(math.pi)) * e))
             .when(df == 4, e * (_lit(1.0) + half)))


def chisq_upper_p_any(x: Column, df: Column) -> Column:
    """P(X > x) for chi-square with any whole number of degrees of freedom in a column.

    Q(a + 1, z) = Q(a, z) + z^a e^-z / Gamma(a + 1), from Q(1/2) or Q(1) up to a = df / 2;
    the terms are positive and built from their logarithms, so nothing cancels or overflows.
    """
    z = x / _lit(2.0)
    odd = (df % 2) == 1
    # The first term is that of a = 1/2 or, with Q(0) = 0 for z > 0, that of a = 0.
    a = F.when(odd, _lit(0.5)).otherwise(_lit(0.0))
    log_gamma = F.when(odd, _lit(math.lgamma(1.5))).otherwise(_lit(0.0))
    terms = F.floor(df / 2).cast("int")
    safe = F.greatest(z, _lit(FPMIN))
    step = F.aggregate(
        F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")),
        F.struct((a * F.log(safe) - z - log_gamma).alias("log"), a.alias("a"), _lit(0.0).alias("s")),
        lambda acc, i: F.struct((acc["log"] + F.log(safe) - F.log(acc["a"] + 1.0)).alias("log"),
                                (acc["a"] + 1.0).alias("a"), (acc["s"] + F.exp(acc["log"])).alias("s")))
    start = F.when(odd, gamma_q_half(z)).otherwise(_lit(0.0))
    return F.when((df == 0) | (x <= 0), _lit(1.0)).otherwise(_unit(start + step["s"]))


def yates_chisq(n11: Column, mx: Column, my: Column, n: Column) -> Column:
    """Continuity-corrected chi-square of a 2x2 table from one cell and margins.

    All four cells deviate from expectation by the same ``d``; the corrected
    statistic is ``(d - min(0.5, d))^2 * sum(1/E)`` with
    ``sum(1/E) = N^3 / (mx (N-mx) my (N-my))``.  NULL when a margin is empty
    (the table degenerates).
    """
    nd, mxd, myd, n11d = (c.cast("double") for c in (n, mx, my, n11))
    d = F.abs(nd * n11d - mxd * myd) / nd
    corr = d - F.least(d, _lit(0.5))
    inv_e = (nd * nd * nd) / (mxd * (nd - mxd) * myd * (nd - myd))
    ok = (mxd > 0) & (mxd < nd) & (myd > 0) & (myd < nd)
    return F.when(ok, corr * corr * inv_e)


def log_or_se(cells: list[Column]) -> Column:
    """Asymptotic standard error of a log odds ratio: sqrt(sum 1/n)."""
    total = None
    for c in cells:
        term = _lit(1.0) / c.cast("double")
        total = term if total is None else total + term
    return F.sqrt(total)
