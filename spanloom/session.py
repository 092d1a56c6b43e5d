"""A session with the settings the engine expects."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "spanloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, AQE with skew handling, Arrow; shuffle partitions are left to the cluster unless given."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def local(cpus: int | str | None = None, **conf: str) -> SparkSession:
    n = cpus or os.environ.get("BENCH_CPUS", "8")
    return session(master=f"local[{n}]", **({"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g", "spark.ui.enabled": "false"} | conf))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder that the session names; only where it names none, in a temporary one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spanloom-checkpoint-"))
    return df.checkpoint()
