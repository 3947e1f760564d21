"""Tables kept in buckets of their key: joins and aggregates by that key need no shuffle.

The event log and the parcel marts are joined by parcel in every report.  Written once into the same number of buckets,
each bucket of the log meets its bucket of the parcels where it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.lookups import hot_keys


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, share: float = 0.02) -> bool:
    """Save ``df`` as a table of ``buckets`` buckets sorted by ``key``; False if it is saved without buckets.

    A bucket is read by one task and cannot be split.  So the key is looked at first, by a frequent-items sketch: if one
    value, or rows without a key, hold ``share`` of the rows, the table is saved plainly, and joins with it are shuffled,
    where adaptive execution splits the hot key.  Size ``buckets`` so that one fits a task (some 200 MB): tables that are
    joined must have the same number, or one a multiple of the other.
    """
    keyless, rows = df.select(F.count_if(F.col(key).isNull()), F.count(F.lit(1))).first()
    hot = df.sparkSession.range(1).select(hot_keys(df, [key], share, most=max(40, round(1 / share))).alias("hot")).first().hot
    if hot or keyless > rows * share:
        df.write.mode("overwrite").format("parquet").saveAsTable(table)
        return False
    # dealt as the buckets are, so that each bucket is one file and not one of every task
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return True


def bucketed_on(spark: SparkSession, table: str) -> list[str]:
    """The columns a table is bucketed by; none for a plain table."""
    return [c.name for c in spark.catalog.listColumns(table) if c.isBucket]
