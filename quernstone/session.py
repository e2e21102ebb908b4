"""A Spark session with the settings that the engine's results rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, memory: str = "8g", **more: str) -> SparkSession:
    """A session in one process, for tests and the bench. On a cluster, use the one that it gives."""
    cpus = cpus or os.cpu_count() or 4
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory} | more
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("quernstone").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
