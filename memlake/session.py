"""Session defaults: UTC, adaptive execution, Arrow transfer."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # Small local files are read by all cores where they have several row groups.
    "spark.sql.files.maxPartitionBytes": "8m",
    "spark.sql.files.openCostInBytes": "1m",
}


def local_session(cpus: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    n = os.cpu_count() if cpus == "*" else int(cpus)
    builder = SparkSession.builder.master(f"local[{n}]").config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(n), **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
