"""Demographic profile tables.

All tables share one shape: the attribute columns of one row per episode are
unpivoted to ``(groupname, rowname)`` and counted; shares divide by the group
total; periods or months become columns through a pivot with explicit
values (no extra job to discover them).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapcase.functions.bins import cut_bins
from snapcase.functions.text import percent_text, title_case
from snapcase.operators.episodes import (BOOKING, TS, before_end, episode_end, first_per_group,
                                         in_year, pretrial_rowlevel, ts_literal)

# Display group name -> source column.
TITLED_GROUPS = (("Gender", "Gender"), ("Race", "RaceDescription"),
                 ("Marital Status", "MaritalStatus"), ("Age", "age_group"))
RAW_GROUPS = (("Gender", "Gender"), ("RaceDescription", "RaceDescription"),
              ("MaritalStatus", "MaritalStatus"), ("age_group", "age_group"))
ATTRIBUTES = ("Gender", "RaceDescription", "MaritalStatus", "age_group")

# Month names in calendar order (the column order of the tables).
MONTHS = ("January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December")

DEFAULT_CATEGORIES = (("FELONY", "fel"), ("MISDEMEANOR", "mis"))

_ONE_DAY = dt.timedelta(days=1)


def with_age_group(df: DataFrame, age: str = "CurrentAge", width: int = 10,
                   name: str = "age_group") -> DataFrame:
    return df.withColumn(name, cut_bins(F.col(age), 0, 100, width))


def profile_counts(df: DataFrame, groups: Sequence[tuple[str, str]] = TITLED_GROUPS,
                   by: Sequence[str] = (), missing: str | None = "Missing",
                   title: bool = True) -> DataFrame:
    """Count each level of each attribute (C09): ``by + [groupname, rowname, n]``.

    Title casing runs after the count, on the small aggregated rows; levels
    that collapse to the same label are summed.
    """
    by = list(by)
    names = [g for g, _ in groups]
    wide = df.select(*by, *[F.col(c).cast("string").alias(g) for g, c in groups])
    long = wide.unpivot(by, [F.col(f"`{g}`") for g in names], "groupname", "rowname")
    counts = long.groupBy(*by, "groupname", "rowname").agg(F.count(F.lit(1)).alias("n"))
    if not title and missing is None:
        return counts
    label = F.col("rowname")
    if title:
        label = title_case(label)
    if missing is not None:
        label = F.coalesce(label, F.lit(missing))
    return (counts.withColumn("rowname", label)
                  .groupBy(*by, "groupname", "rowname")
                  .agg(F.sum("n").cast("long").alias("n")))


def with_shares(counts: DataFrame, by: Sequence[str], name: str = "share") -> DataFrame:
    """``n / sum(n)`` within ``by + [groupname]`` (window over aggregated rows)."""
    w = Window.partitionBy(*by, "groupname")
    return counts.withColumn(name, F.col("n").cast("double") / F.sum("n").over(w).cast("double"))


def profile_monthly_counts(df: DataFrame, year: int, category: str,
                           category_col: str = "ChargeCategory") -> DataFrame:
    """Month x level episode counts with a Total row per group.

    Rows: pre-trial by the row-level rule (blank disposition) in ``year`` and
    ``category``; each episode counted once, in the month of its first row.
    Level cells with no episodes are NULL; Total cells sum the month.
    """
    rows = with_age_group(pretrial_rowlevel(df, year).filter(F.col(category_col) == category))
    first = first_per_group(rows, BOOKING, [TS], ATTRIBUTES)
    first = first.withColumn("month", F.date_format(F.col(TS), "MMMM"))
    counts = profile_counts(first, RAW_GROUPS, by=["month"], missing=None, title=False)
    wide = counts.groupBy("groupname", "rowname").pivot("month", list(MONTHS)).agg(F.first("n"))
    totals = wide.groupBy("groupname").agg(
        *[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in MONTHS])
    levels = wide.select("groupname", "rowname", F.lit(False).alias("is_total"),
                         *[F.col(m).cast("long").alias(m) for m in MONTHS])
    return levels.unionByName(
        totals.select("groupname", F.lit("Total").alias("rowname"),
                      F.lit(True).alias("is_total"), *MONTHS))


def _suffix(categories, category_col: str):
    expr = None
    for cat, suffix in categories:
        expr = (F.when(F.col(category_col) == cat, F.lit(suffix)) if expr is None
                else expr.when(F.col(category_col) == cat, F.lit(suffix)))
    return expr


def profile_monthly_shares(df: DataFrame, year: int, categories=DEFAULT_CATEGORIES,
                           category_col: str = "ChargeCategory",
                           ends: DataFrame | None = None) -> DataFrame:
    """Share of each level within month x category among pre-trial episodes (C11).

    Pre-trial is the episode rule (rows before the first disposition).  One
    row per (episode, category): the first exposure row in ``year``.  Columns
    ``<Month>_<suffix>`` for every category, missing cells 0.
    """
    rows = df.filter(in_year(df, year) & F.col(category_col).isin([c for c, _ in categories]))
    first = first_per_group(with_age_group(rows), [*BOOKING, category_col], [TS], ATTRIBUTES)
    first = before_end(first, ends if ends is not None else episode_end(df))
    first = first.withColumn("col", F.concat(F.date_format(F.col(TS), "MMMM"), F.lit("_"),
                                             _suffix(categories, category_col)))
    shares = with_shares(profile_counts(first, TITLED_GROUPS, by=["col"]), ["col"])
    cols = [f"{m}_{s}" for _, s in categories for m in MONTHS]
    return (shares.groupBy("groupname", "rowname").pivot("col", cols).agg(F.first("share"))
                  .fillna(0.0, subset=cols))


def period_label(periods, day) -> F.Column:
    """Names of all periods (name, start, end inclusive) containing ``day``.

    A literal array filtered per row: no join, and overlapping periods give a
    row to each of them.
    """
    arr = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("start"),
                             F.lit(e).alias("end")) for n, s, e in periods])
    return F.transform(F.filter(arr, lambda p: (day >= p["start"]) & (day <= p["end"])),
                       lambda p: p["name"])


def profile_period_shares(df: DataFrame, periods, categories=DEFAULT_CATEGORIES,
                          category_col: str = "ChargeCategory",
                          ends: DataFrame | None = None) -> DataFrame:
    """Share of each level per period x category among pre-trial episodes.

    ``periods`` is a list of ``(name, start_date, end_date)``.  Output columns
    ``n_<period>_<suffix>``; levels absent from a column get 0.
    """
    lo = min(p[1] for p in periods)
    hi = max(p[2] for p in periods)
    # The overall range is pushed to the scan; the per-period split follows.
    rows = df.filter((F.col(TS) >= ts_literal(df, TS, lo)) & (F.col(TS) < ts_literal(df, TS, hi + _ONE_DAY))
                     & F.col(category_col).isin([c for c, _ in categories]))
    rows = with_age_group(rows).withColumn("period", F.explode(period_label(periods, F.to_date(F.col(TS)))))
    first = first_per_group(rows, [*BOOKING, "period", category_col], [TS], ATTRIBUTES)
    first = before_end(first, ends if ends is not None else episode_end(df))
    first = first.withColumn("col", F.concat(F.lit("n_"), F.col("period"), F.lit("_"),
                                             _suffix(categories, category_col)))
    shares = with_shares(profile_counts(first, TITLED_GROUPS, by=["col"]), ["col"])
    cols = [f"n_{p[0]}_{s}" for p in periods for _, s in categories]
    return (shares.groupBy("groupname", "rowname").pivot("col", cols).agg(F.first("share"))
                  .fillna(0.0, subset=cols))


def share_display(wide: DataFrame, pairs: Sequence[tuple[str, str, str]],
                  decimals: int = 2) -> DataFrame:
    """Merge two share columns into ``"12.34%<br>(5.67%)"``.

    ``pairs``: (output name, upper column, lower column); missing shares show
    as 0.
    """
    out = [F.col("groupname"), F.col("rowname")]
    for name, upper, lower in pairs:
        u = percent_text(F.coalesce(F.col(upper), F.lit(0.0)), decimals)
        low = percent_text(F.coalesce(F.col(lower), F.lit(0.0)), decimals)
        out.append(F.concat(u, F.lit("<br>("), low, F.lit(")")).alias(name))
    return wide.select(*out)

__all__ = ["profile_counts", "with_shares", "profile_monthly_counts", "profile_monthly_shares",
           "profile_period_shares", "share_display", "period_label",
           "TITLED_GROUPS", "RAW_GROUPS", "MONTHS"]
