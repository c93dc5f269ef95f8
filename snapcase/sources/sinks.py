"""Result tables (C35): persist a result for later reports and read it back.

Results go under the shared folder named by ``spark.checkpoint.dir`` (see
:func:`snapcase.session.results_path`) as parquet, written atomically by
Spark's commit protocol, so a lost executor only re-runs its task.  Every
application writes to a run folder of its own, so two that save at once both
read back their own tables; another application names the run to read it.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from snapcase.session import results_path

_RUNS: dict[str, str] = {}


def run_name(spark: SparkSession) -> str:
    """The run folder of this application, drawn at its first use."""
    return _RUNS.setdefault(spark.sparkContext.applicationId, f"run-{uuid.uuid4().hex}")


def write_result(df: DataFrame, name: str, partition_by: list[str] | None = None,
                 run: str | None = None) -> str:
    """Write a result table, replacing that of the same run and name; its path."""
    path = results_path(df.sparkSession, f"{run or run_name(df.sparkSession)}/{name}")
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def read_result(spark: SparkSession, name: str, run: str | None = None) -> DataFrame:
    return spark.read.parquet(results_path(spark, f"{run or run_name(spark)}/{name}"))


def save_report(tables: Mapping[str, DataFrame], report: str, run: str | None = None) -> dict[str, str]:
    """Write every table of a report (see ``plans.reports``); their paths by name."""
    return {name: write_result(df, f"{report}/{name}", run=run) for name, df in tables.items()}


def read_report(spark: SparkSession, report: str, names, run: str | None = None) -> dict[str, DataFrame]:
    """Tables saved by :func:`save_report`."""
    return {name: read_result(spark, f"{report}/{name}", run) for name in names}
