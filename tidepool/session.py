"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC for oracles, adaptive plans, and maps in which the last of equal keys wins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that exists."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def session(master: str | None = None, **options: str) -> SparkSession:
    builder = SparkSession.builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in options.items()})
    return configure((builder.master(master) if master else builder).getOrCreate())
