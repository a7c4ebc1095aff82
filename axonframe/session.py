"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "axonframe", **conf: object) -> SparkSession:
    """The active session, or a new one. UTC, adaptive plans with skewed joins split; all else is the cluster's.

    ``spark.checkpoint.dir`` must name a folder that driver and executors share; it is never set here.
    """
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
