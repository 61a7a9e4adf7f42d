"""Session settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE with skew joins, and Arrow; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()
