"""Session settings every job here relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Wall-clock times carry no zone, so the session zone must not shift them; bad
# values must become NULL through the try_ functions, not through lax casts.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def survey_session(app: str = "firnline", **extra: str) -> SparkSession:
    """Get or start a session with the settings above; `extra` uses '__' for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
