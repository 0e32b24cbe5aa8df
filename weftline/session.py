"""Session settings the library is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI mode, AQE and its skew handling are on by default in Spark 4; times are read as UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "weftline", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; keyword settings have '_' for '.' in their names."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
