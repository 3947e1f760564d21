"""Scans: tables, snapshots, partition ranges, versions, calendars, id lists."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table; ``name`` may carry catalog and schema."""
    return spark.table(name)


def read_files(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: str | None = None, **options) -> DataFrame:
    """A file source (Parquet, ORC, CSV, JSON) - also for exported sheets."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def snapshot(df: DataFrame, as_of: dt.date, lag: int = 1,
             partition: str = "grass_date") -> DataFrame:
    """The full snapshot written ``lag`` days before ``as_of``.

    The day is a literal, so a partitioned table is pruned to one directory
    and a plain Parquet table gets a pushed equality filter.
    """
    return df.where(F.col(partition) == F.lit(as_of - dt.timedelta(days=lag)))


def partition_range(df: DataFrame, since: dt.date, region: str | None = None,
                    partition: str = "grass_date", region_column: str = "grass_region",
                    inclusive: bool = True) -> DataFrame:
    """All partitions from ``since`` on, optionally of one region."""
    bound = F.lit(since)
    keep = F.col(partition) >= bound if inclusive else F.col(partition) > bound
    if region is not None:
        keep = keep & (F.col(region_column) == region)
    return df.where(keep)


def days_of(dates: DataFrame, where: Column, day: str = "day") -> DataFrame:
    """The days of a date table that satisfy ``where``, each once; see :func:`restrict_to_days`."""
    return dates.where(where & F.col(day).isNotNull()).select(F.col(day).alias("__day")).distinct()


def restrict_to_days(df: DataFrame, days: DataFrame, partition: str = "grass_date") -> DataFrame:
    """Rows of the days in ``days``, for questions whose days are known only from data (a month of a date table, the
    days of a campaign).

    It is a semi join on the partition column: the small side is read first, and only the directories of its days are
    listed and read.
    """
    return df.join(days, F.col(partition) == F.col("__day"), "left_semi")


def write_by_day(df: DataFrame, path: str, day: Column, partition: str = "grass_date", spread: str | None = None,
                 files: int = 8) -> None:
    """Write ``df`` partitioned by day, replacing the days it has rows of and no others.

    A day is written by at most ``files`` tasks, by the hash of ``spread``: without that every task would write a file
    of every day, while one task a day would hold a hot day alone.  Rows without a day go to Spark's default partition.
    """
    keyed = df.withColumn(partition, day)
    part = F.pmod(F.xxhash64(spread), F.lit(files)) if spread else F.lit(0)
    keyed.repartition(F.col(partition), part).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


@dataclass(frozen=True)
class Scope:
    """Which partitions of the marts a report reads.

    ``as_of`` names the snapshot (written ``lag`` days before); ``orders_since`` keeps the order partitions after that
    day, ``log_since`` and ``log_until`` bound the days of the event log, and ``region`` is a partition as well.  A mart
    without the partition column is read whole, so the same report runs on an unpartitioned copy.
    """

    as_of: dt.date
    orders_since: dt.date | None = None
    log_since: dt.date | None = None
    log_until: dt.date | None = None
    region: str | None = None
    lag: int = 1
    partition: str = "grass_date"
    region_column: str = "grass_region"

    def snapshot(self, mart: DataFrame) -> DataFrame:
        if self.partition not in mart.columns:
            return mart
        return self._of_region(snapshot(mart, self.as_of, self.lag, self.partition))

    def orders(self, mart: DataFrame) -> DataFrame:
        return self._days(mart, self.orders_since, None, inclusive=False)

    def log(self, log: DataFrame) -> DataFrame:
        return self._days(log, self.log_since, self.log_until)

    def _days(self, df: DataFrame, since: dt.date | None, until: dt.date | None, inclusive: bool = True) -> DataFrame:
        if self.partition not in df.columns:
            return df
        if since is not None:
            df = partition_range(df, since, partition=self.partition, inclusive=inclusive)
        if until is not None:
            df = df.where(F.col(self.partition) <= F.lit(until))
        return self._of_region(df)

    def _of_region(self, df: DataFrame) -> DataFrame:
        if self.region is None or self.region_column not in df.columns:
            return df
        return df.where(F.col(self.region_column) == self.region)


def latest_version(df: DataFrame, version: str = "ingestion_timestamp") -> DataFrame:
    """Rows of the newest upload of a versioned reference table.

    The maximum is an uncorrelated scalar subquery: it stays inside the plan
    and is computed once however often the table is joined.
    """
    newest = df.select(F.max(version)).scalar()
    return df.where(F.col(version) == newest)


def calendar(spark: SparkSession, days: Iterable[str], name: str = "sla_date") -> DataFrame:
    """An inline list of days as a one-column DATE relation, without repeats.

    The days are literals of the plan, so the planner knows how small the
    relation is and a join with it needs no shuffle of the other side.
    """
    literals = F.array(*[F.lit(d).cast("date") for d in dict.fromkeys(days)])
    return spark.range(1).select(F.explode(literals).alias(name))


def restrict_to_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Keep rows whose id is in the first column of ``ids`` (left semi join).

    Works for any number of ids: a short list is broadcast by the planner, a
    long one is a shuffled semi join.
    """
    keys = ids.select(F.col(ids.columns[0]).alias("__id"))
    return df.join(keys, df[column] == F.col("__id"), "left_semi")


def restrict_to_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Parameter list given by the caller (an empty list keeps nothing)."""
    keep: Column = F.col(column).isin(*values) if values else F.lit(False)
    return df.where(keep)


def restrict_by_parameter(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """As :func:`restrict_to_values` with the list bound to a parameter marker: the statement is the same for any list.

    The list is text of no statement, so nothing has to be quoted or typed in, and statements of a report can be compared
    or kept.  It becomes the small side of a semi join; nulls in it match nothing, an empty list keeps nothing.  The
    values are read as the column's type; one that cannot be read is an error.
    """
    kind = df.schema[column].dataType.simpleString()
    statement = f"SELECT * FROM {{facts}} WHERE `{column}` IN (SELECT explode(CAST(:listed AS array<{kind}>)))"
    listed = [v for v in values if v is not None] or F.array()
    return df.sparkSession.sql(statement, args={"listed": listed}, facts=df)


def enrich_list(ids: DataFrame, facts: DataFrame, id_column: str, fact_key: str,
                columns: Sequence[str]) -> DataFrame:
    """Every listed id with the fact columns, NULL where the fact is unknown."""
    listed = ids.select(F.col(ids.columns[0]).alias(id_column)).where(
        F.col(id_column).isNotNull())
    side = facts.select(F.col(fact_key).alias("__key"), *columns)
    return listed.join(side, F.col(id_column) == F.col("__key"), "left").drop("__key")
