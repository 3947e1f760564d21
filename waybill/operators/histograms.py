"""Counted histograms: exact averages and percentiles of whole-numbered or coarse values in one pass.

A histogram is a table with a row for each group and value and its number of rows.  It is small (as many rows as there are
different values in a group), two of them merge by adding the numbers, and every discrete percentile can be read from it
exactly.  So the figures of a month are those of its merged days, and no sketch and no second pass over the facts is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def value_histogram(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by``, ``value`` and ``n``: rows of each group and value; a null value is counted like any other."""
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def merge_histograms(parts: Sequence[DataFrame], by: Sequence[str], value: str) -> DataFrame:
    """One histogram of several, for instance of the days of a month; ``by`` may be coarser than the parts."""
    if not parts:
        raise ValueError("nothing to merge")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*by, value).agg(F.sum("n").alias("n"))


def sorted_counts(value: str, n: str = "n", where: Column | None = None) -> Column:
    """Aggregate: the histogram of a group as an array of (value, n), ascending; null values are left out.

    The array is as long as a group has different values, which for lead times in days is a few hundred.
    """
    known = F.col(value).isNotNull() if where is None else F.col(value).isNotNull() & where
    return F.array_sort(F.collect_list(F.when(known, F.struct(F.col(value).alias("value"), F.col(n).alias("n")))))


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda seen, x: seen + x["n"])


def mean(counts: Column) -> Column:
    """Average; null without rows."""
    summed = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x["value"].cast("double") * x["n"])
    return F.when(F.size(counts) > 0, summed / total(counts))


def discrete_percentile(counts: Column, percent: int) -> Column:
    """The smallest value that at least ``percent`` of the rows do not exceed; null without rows.

    ``counts`` is sorted by value; one value may stand in it several times, so arrays of several groups can be put
    together and sorted without adding them up.  The rank is taken of whole numbers, so no product like 0.95 * n is rounded.
    """
    rank = F.floor((total(counts) * percent + 99) / 100)
    empty = F.struct(F.lit(0).cast("bigint").alias("seen"), F.element_at(counts, 1)["value"].alias("value"),
                     F.lit(False).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["n"]
        return F.struct(seen.alias("seen"), F.when(acc["found"], acc["value"]).otherwise(x["value"]).alias("value"),
                        (acc["found"] | (seen >= rank)).alias("found"))

    return F.when(F.size(counts) > 0, F.aggregate(counts, empty, step, lambda acc: acc["value"]))


def histogram_figures(counts: str, percents: Sequence[int], digits: int, suffix: str = "") -> list[Column]:
    """Mean and percentiles of the array column ``counts``, rounded and named ``avg...`` and ``percentile_...``."""
    c = F.col(counts)
    return [F.round(mean(c), digits).alias(f"avg{suffix}")] + [
        F.round(discrete_percentile(c, p), digits).alias(f"percentile_{p}{suffix}") for p in percents]


def histogram_and_distinct(df: DataFrame, by: Sequence[str], value: str, item: str) -> DataFrame:
    """``by``, ``counts`` (array of value and n) and ``items`` (different non-null ``item``) per group, from one scan.

    Rows are counted once per value and once per item in the same aggregate; both kinds of row are combined in each task
    before the shuffle, so an item or a group that holds a third of all rows costs one row per task.
    """
    counted = df.groupingSets([[*by, value], [*by, item]], *by, value, item).agg(
        F.count(F.lit(1)).alias("n"), F.grouping(item).alias("__of_value"))
    of_value = F.col("__of_value") == 1
    return counted.groupBy(*by).agg(
        sorted_counts(value, where=of_value).alias("counts"),
        F.count(F.when(~of_value, F.col(item))).alias("items"))
