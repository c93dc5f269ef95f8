"""Running sums over an ordered axis, by ranges with offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Steps of the axis in one range.
RANGE = 1024


def running_sums(df: DataFrame, part: Sequence[str], at: str, values: Sequence[str],
                 span: int = RANGE) -> DataFrame:
    """``df`` with ``<value>_upto``, the sum of each value over the rows up to and with this one.

    ``at`` is a date or whole number, one row for each (part, at).  The axis is cut into
    ranges of ``span`` steps: rows are added up within their range, and ranges by their
    totals, so no task holds a whole part.
    """
    axis: Column = F.unix_date(at) if dict(df.dtypes)[at] == "date" else F.col(at).cast("long")
    ranged = df.withColumn("_range", F.floor(axis / span))
    totals = ranged.groupBy(*part, "_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(*[F.col(p) for p in part]).orderBy("_range")
    names = [f"_k_{i}" for i in range(len(part))]
    totals = totals.select(
        *[F.col(p).alias(k) for p, k in zip(part, names)], F.col("_range").alias("_r"),
        *[(F.sum(f"_t_{v}").over(before) - F.col(f"_t_{v}")).alias(f"_o_{v}") for v in values])
    same = [F.col(p).eqNullSafe(F.col(k)) for p, k in zip(part, names)] + [F.col("_range") == F.col("_r")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    within = Window.partitionBy(*[F.col(p) for p in part], "_range").orderBy(at)
    out = ranged.withColumns({f"_w_{v}": F.sum(v).over(within) for v in values}).join(totals, on)
    out = out.withColumns({f"{v}_upto": F.col(f"_w_{v}") + F.col(f"_o_{v}") for v in values})
    return out.select(*df.columns, *[f"{v}_upto" for v in values])
