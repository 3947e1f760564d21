"""Session settings the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Epoch seconds and wall-clock hours must mean the same on every executor.
    "spark.sql.session.timeZone": "UTC",
    # Run-time re-planning: coalesces small shuffle partitions, splits skewed
    # ones and turns a sort-merge join into a broadcast join once the real
    # size of a side is known.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed partitions even when that costs one more shuffle later on:
    # a straggler holding a third of the rows is always dearer.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Before a query runs, a side is only broadcast when its estimate (which is
    # made from compressed files) is really small, as reference tables are.
    # While it runs, sizes are measured, so the bound may be wider.  Anything
    # larger is joined by the skew-aware sort-merge join.
    "spark.sql.autoBroadcastJoinThreshold": "8MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
}


def build_session(app_name: str = "waybill", **overrides: str) -> SparkSession:
    """Get or create a session with :data:`SETTINGS`.

    ``overrides`` use underscores for dots, e.g. ``spark_sql_shuffle_partitions``.
    The master is left to ``spark-submit``.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in overrides.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def use_report_clock(spark: SparkSession) -> SparkSession:
    """Pin the session time zone on a session somebody else built."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
