"""Session settings the engine is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution re-plans joins and partition counts from what stages really wrote, and splits skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def create_session(app: str = "brindle", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS, then whatever is given; the cluster's own settings fill in the rest."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
