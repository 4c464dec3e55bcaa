"""Session defaults. Every setting is a default only: what the caller or cluster sets wins."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", **conf) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("webloom")
    n = os.cpu_count() if cores == "*" else int(cores)
    own = {"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1"}
    for k, v in (DEFAULTS | own | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
