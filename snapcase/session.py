"""Session construction and shared-folder lookup."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (timestamps are compared with
# DuckDB), adaptive execution for runtime re-planning, skew-join splitting and
# partition coalescing.
_BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "snapcase", extra: dict | None = None) -> SparkSession:
    """Return a session with the settings the operators assume.

    ``master`` and ``shuffle_partitions`` are only applied when given; on a
    cluster the launcher decides both.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _BASE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors for checkpoints and result tables.

    Read from ``spark.checkpoint.dir`` (the cluster names it).  Only a local master
    gets a fresh folder when it is unset; any other master is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="snapcase-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server reads spark.checkpoint.dir
        return base
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def results_path(spark: SparkSession, name: str) -> str:
    """Location of a named result table under the shared folder."""
    return os.path.join(shared_dir(spark).rstrip("/"), "results", name)
