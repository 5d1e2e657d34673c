"""A session with the settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sparkloft", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """UTC, adaptive execution with skew joins; on a cluster leave ``master`` and ``shuffle_partitions`` to the submit settings."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", shuffle_partitions)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
