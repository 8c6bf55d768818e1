"""Session settings the library is run with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "curate", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC times, adaptive execution and skew handling on; cluster settings come from outside."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
