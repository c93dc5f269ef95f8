"""Every combination of two lists, as a distributed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parts that each side is cut into; every pair of parts can be a task of its own.
PARTS = 8


def combinations(left: DataFrame, right: DataFrame, parts: int = PARTS) -> DataFrame:
    """Each row of ``left`` with each row of ``right``; the size of the answer, at any size.

    For results that list every combination.  Both sides are cut into ``parts`` by a hash
    and meet part by part in an ordinary join, so neither list is gathered in one row, in
    one task or on the driver.  The sides must not share column names.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    part_l, part_r = (F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in side.columns]),
                             F.lit(parts)).cast("int") for side in (left, right))
    placed_l = left.withColumn("_part_l", part_l).withColumn("_part_r", every)
    placed_r = right.withColumn("_part_r", part_r).withColumn("_part_l", every)
    return placed_l.join(placed_r, ["_part_l", "_part_r"]).drop("_part_l", "_part_r")
