"""Session defaults. The master, memory and executors are the cluster's to set."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Partial aggregates leave the shuffles small, so AQE is left to size them; only large joins
# (an events feed with a large customer table) need many partitions and the skew split.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Otherwise every Column built in Python records its call site, at a millisecond or more each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "weekpulse", **overrides: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
