"""Uncertainty of shares when rows are not independent (Q04): cluster bootstrap.

Every cluster (a booking, a person) draws one Poisson(1) weight for each replicate from a
hash of its name, so all its rows move together, no rows are copied, and a run gives the
same weights on any cluster.  One aggregation carries the sums of all replicates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPLICATES = 48
# Replicates that one 128-bit hash serves, 16 bits each.
OF_A_HASH = 8
# P(Poisson(1) <= k), as 16-bit levels: the weight is the number of levels at or below the draw.
LEVELS = [round(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]


def poisson_weights(cluster: Column, replicates: int = REPLICATES) -> Column:
    """Array of the weights of a cluster, one for each replicate."""
    hashes = [F.md5(F.concat(cluster.cast("string"), F.lit(f":{i}")).cast("binary"))
              for i in range(-(-replicates // OF_A_HASH))]
    draws = F.concat(*[F.array(*[F.conv(F.substring(h, 4 * j + 1, 4), 16, 10).cast("int")
                                 for j in range(OF_A_HASH)]) for h in hashes])
    weight = lambda u: F.expr("0") + sum(
        [F.when(u >= level, 1).otherwise(0) for level in LEVELS if level < 65536], F.lit(0))
    return F.transform(F.slice(draws, 1, replicates), weight)


def share_intervals(df: DataFrame, level: str, cluster: Sequence[str], within: Sequence[str] = (),
                    replicates: int = REPLICATES, coverage: float = 0.95) -> DataFrame:
    """Share of each level, with a percentile interval over the replicates.

    ``df`` has one row per unit; units of one cluster are drawn together.  A NULL level is a
    level of its own, NULL clusters form one cluster.
    Output: ``within, level, n, share, lower, upper``.
    """
    within = list(within)
    name = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cluster])
    per_cluster = df.groupBy(*within, F.col(level).alias(level), name.alias("_c")).agg(
        F.count(F.lit(1)).alias("_n"))
    weighted = per_cluster.withColumn("_w", poisson_weights(F.col("_c"), replicates))
    sums = weighted.groupBy(*within, level).agg(
        F.sum("_n").alias("n"),
        *[F.sum(F.col("_n") * F.get("_w", F.lit(i))).alias(f"_s{i}") for i in range(replicates)])
    # One row per level from here on.
    all_levels = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    shares = F.array(*[F.try_divide(F.col(f"_s{i}").cast("double"), F.sum(f"_s{i}").over(all_levels).cast("double"))
                       for i in range(replicates)])
    tail = (1 - coverage) / 2
    low, high = math.floor(tail * (replicates - 1)), math.ceil((1 - tail) * (replicates - 1))
    out = sums.withColumn("_all", F.array_sort(shares)).withColumn(
        "share", F.col("n").cast("double") / F.sum("n").over(all_levels).cast("double"))
    return out.select(*within, level, F.col("n").cast("long").alias("n"), "share",
                      F.get("_all", F.lit(low)).alias("lower"), F.get("_all", F.lit(high)).alias("upper"))
