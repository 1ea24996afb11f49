"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .streaming.live import STATE_STORE


def session(app: str = "tapeloom", **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` overrides and adds."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **STATE_STORE,
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
