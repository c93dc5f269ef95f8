"""Episodes kept up to date snapshot by snapshot (C05-C07), without reading old rows again.

The state has one row per episode: first day, first row and end.  All three are minima, so
states merge by taking minima again, in any order, and a day that arrives twice changes
nothing.  A new batch is aggregated to episodes and merged with the state, which is then
written anew; readers follow the last complete version.  A correction that removes rows of
an old day needs a rebuild from the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcase.operators.episodes import BOOKING, STATUS, TS
from snapcase.session import results_path


def episode_partials(rows: DataFrame, carry: Sequence[str], keys: Sequence[str] = BOOKING, ts: str = TS,
                     status: str = STATUS) -> DataFrame:
    """Mergeable state of the episodes of some rows: keys, first_day, first, end_pretrial.

    ``first`` is the smallest row by time, then by the carried columns, NULLs first.
    """
    day = F.to_date(F.col(ts))
    return rows.groupBy(*keys).agg(
        F.min(day).alias("first_day"),
        F.min(F.struct(F.col(ts), *[F.col(c) for c in carry if c != ts])).alias("first"),
        F.min(F.when(F.col(status).isNotNull(), day)).alias("end_pretrial"))


def merged(one: DataFrame, other: DataFrame, keys: Sequence[str] = BOOKING) -> DataFrame:
    """The state of the rows behind both states."""
    return one.unionByName(other).groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in ("first_day", "first", "end_pretrial")])


class EpisodeState:
    """Episode state on shared files, extended by batches of snapshot rows."""

    def __init__(self, spark: SparkSession, carry: Sequence[str], keys: Sequence[str] = BOOKING,
                 ts: str = TS, status: str = STATUS):
        self.spark, self.carry, self.keys, self.ts, self.status = spark, list(carry), list(keys), ts, status
        self.folder = results_path(spark, f"episodes/{uuid.uuid4().hex}")
        self.versions = 0
        self.state: DataFrame | None = None

    def add(self, rows: DataFrame) -> None:
        """Merge a batch, for instance a new snapshot day."""
        fresh = episode_partials(rows, self.carry, self.keys, self.ts, self.status)
        new = fresh if self.state is None else merged(self.state, fresh, self.keys)
        path = f"{self.folder}/version-{self.versions:06d}"
        new.write.parquet(path)
        # The old version stays until the new one is whole.
        self.state = self.spark.read.schema(new.schema).parquet(path)
        self.versions += 1

    def ends(self) -> DataFrame:
        """First disposition day of the episodes (as ``episode_end``): keys, end_pretrial."""
        keys = self.keys
        per_id = self.state.groupBy(keys[0]).agg(
            F.min("first_day").alias("_day"), F.max(F.col("end_pretrial").isNotNull()).alias("_has"))
        since = per_id.filter("_has").agg(F.min("_day")).scalar()
        return self.state.filter(F.col("end_pretrial").isNotNull()
                                 & (F.to_date(F.col(keys[-1])) >= since)).select(*keys, "end_pretrial")

    def first_rows(self) -> DataFrame:
        """First row of each episode, with the carried columns."""
        return self.state.select(*self.keys, F.col(f"first.{self.ts}").alias(self.ts),
                                 *[F.col(f"first.{c}").alias(c) for c in self.carry if c != self.ts])

    def first_exposed(self) -> DataFrame:
        """First rows taken strictly before the end of their episode (C07 over C06).

        Days before the end are the earliest of an episode, so its first row is among them
        whenever any row is.
        """
        ends = self.ends().withColumnRenamed("end_pretrial", "_end")
        return (self.first_rows().join(ends.hint("merge"), self.keys)
                .filter(F.to_date(F.col(self.ts)) < F.col("_end")).drop("_end"))
