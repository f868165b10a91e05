"""Session settings for local runs; on a cluster the submitted configuration wins."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, app: str = "codeloom", settings: dict[str, str] | None = None) -> SparkSession:
    cpus = cpus or os.cpu_count() or 8
    builder = SparkSession.builder
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    return (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
