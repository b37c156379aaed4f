"""Session defaults for single-node use; a cluster's own settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | None = None, memory: str = "12g", **conf: str) -> SparkSession:
    """A local[cores] session with as many shuffle partitions as cores."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": memory,
        "spark.driver.host": "127.0.0.1",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName("newsloom").config(map=settings).getOrCreate()
