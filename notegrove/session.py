"""SparkSession factory with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "notegrove", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, skew joins and UTC; conf overrides (underscores stand for dots)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
