"""Session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lexweave", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword, with __ for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
