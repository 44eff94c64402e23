"""Session defaults. Everything else in the package takes the caller's session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "evalloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew-join splitting on.

    Partition counts and memory stay with the cluster: only settings that change
    plans are given here. Keyword arguments use ``__`` for the dots of a setting.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
