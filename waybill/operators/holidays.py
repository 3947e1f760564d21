"""Holiday calendars of any size: running totals and numbered entries instead of one list per carrier.

:func:`waybill.operators.sla.holidays_in_windows` keeps a carrier's calendar as one list and searches it per row, which
suits a calendar of a few years.  Here a window costs two equality lookups, whatever the calendar's length: what lies in a
window is the total up to its last day less the total before its first.  Same windows, same results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import day
from ..sources.scans import latest_version

#: Keys that match nothing are dealt to this many values, so that rows without a holiday do not meet in one task.
_NO_MATCH = 4096


def _month(x: Column) -> Column:
    return F.year(x) * 12 + F.month(x) - 1


def numbered_entries(cal: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``carrier, kind, first, nb, rank, running, same_before``: the newest calendar, a carrier's days numbered in order.

    ``running`` is the total length up to and with the entry, ``same_before`` the number of the entry before it that has the
    same length.  Repeated uploads of a (day, length) pair count once; a length that cannot be read is 0, a day that
    cannot be read leaves the entry out.
    """
    days = latest_version(cal).where(F.col("type").isin(*kinds)).select(
        F.lower("shipping_carrier").alias("carrier"), F.col("type").alias("kind"),
        F.col("holiday_start").try_cast("date").alias("first"),
        F.coalesce(F.col("nb_holiday").try_cast("int"), F.lit(0)).alias("nb"),
    ).where(F.col("carrier").isNotNull() & F.col("first").isNotNull()).distinct()
    ordered = Window.partitionBy("carrier", "kind").orderBy("first", "nb")
    same = Window.partitionBy("carrier", "kind", "nb").orderBy("rank")
    return days.withColumns({
        "rank": F.row_number().over(ordered),
        "running": F.sum("nb").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    }).withColumn("same_before", F.lag("rank").over(same))


def _last(points: Column) -> Column:
    return F.try_element_at(points, F.lit(-1))


def _monthly(entries: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``carrier, month`` and per kind the totals after each day of that month that has an entry: at most 31."""
    days = entries.groupBy("carrier", "kind", "first").agg(
        F.max("rank").cast("bigint").alias("entries"), F.max_by("running", "rank").alias("days"))
    return days.groupBy("carrier", _month(F.col("first")).alias("month")).agg(*[
        F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("first", "entries", "days")))).alias(f"in_{k}")
        for k in kinds])


def running_totals(entries: DataFrame, kinds: Sequence[str]) -> tuple[DataFrame, Column, Column]:
    """One row per carrier and month from the calendar's first month to its last, and these two months as subqueries.

    Per kind ``in_<kind>`` holds the totals after the days of that month and ``before_<kind>`` the total before it.  The
    size is carriers times months: no row grows with the calendar.
    """
    monthly = _monthly(entries, kinds)
    first, last = (monthly.select(f("month")).scalar() for f in (F.min, F.max))
    months = monthly.select("carrier").distinct().withColumn("month", F.explode(F.sequence(first, last)))
    earlier = Window.partitionBy("carrier").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    return months.join(monthly, ["carrier", "month"], "left").withColumns({
        f"before_{k}": F.last(_last(F.col(f"in_{k}")), ignorenulls=True).over(earlier) for k in kinds}), first, last


def _total_until(df: DataFrame, totals: tuple[DataFrame, Column, Column], carrier: str, kind: str, until: Column,
                 output: str) -> DataFrame:
    """Adds struct ``output`` (entries, days): the totals of the days up to and with ``until``, null where there are none."""
    table, first, last = totals
    side = table.select(F.col("carrier").alias("__carrier"), F.col("month").alias("__month"),
                        F.col(f"in_{kind}").alias("__in"), F.col(f"before_{kind}").alias("__before"))
    # days outside the calendar look at its first or last month
    month = F.when(until.isNotNull(), F.greatest(first, F.least(last, _month(until))))
    out = df.withColumns({"__until": until, "__key": month}).join(
        side, (F.lower(F.col(carrier)) == F.col("__carrier")) & (F.col("__key") == F.col("__month")), "left")
    reached = F.filter("__in", lambda e: e["first"] <= F.col("__until"))
    return out.withColumn(output, F.coalesce(_last(reached), F.col("__before"))).drop(
        "__until", "__key", "__carrier", "__month", "__in", "__before")


def holidays_by_totals(df: DataFrame, cal: DataFrame, carrier: str, windows: Mapping[str, tuple[str, Column, Column]],
                       mode: str = "rows") -> DataFrame:
    """:func:`waybill.operators.sla.holidays_in_windows` for calendars of any size.

    ``mode='sum'`` never multiplies a row.  ``mode='rows'`` repeats a row once per different length in its window: the
    numbers of the window's entries are joined one by one, and an entry stands for its length only if no earlier entry of
    the window has the same.  Rows without a hit, with an unknown carrier or an open window get 0 and are kept.
    """
    if mode not in ("rows", "sum"):
        raise ValueError(f"mode {mode!r}")
    kinds = list(dict.fromkeys(kind for kind, _, _ in windows.values()))
    entries = numbered_entries(cal, kinds)
    totals = running_totals(entries, kinds)
    out = df
    for name, (kind, start, last) in windows.items():
        start, last = day(start), day(last)
        out = out.withColumns({"__start": start, "__last": last})
        out = _total_until(out, totals, carrier, kind, F.date_sub("__start", 1), "__lo")
        out = _total_until(out, totals, carrier, kind, F.col("__last"), "__hi")
        below = F.coalesce(F.col("__lo.entries"), F.lit(0))
        hit = F.coalesce((F.col("__start") <= F.col("__last")) & (F.col("__hi.entries") > below), F.lit(False))
        if mode == "sum":
            value = F.when(hit, F.col("__hi.days") - F.coalesce(F.col("__lo.days"), F.lit(0))).otherwise(0)
            out = out.withColumn(name, value.cast("double"))
        else:
            out = _rows_of_lengths(out, entries.where(F.col("kind") == kind), carrier, name, hit, below)
        out = out.drop("__start", "__last", "__lo", "__hi")
    return out


def _rows_of_lengths(df: DataFrame, entries: DataFrame, carrier: str, output: str, hit: Column, below: Column) -> DataFrame:
    nothing = F.array(-1 - F.pmod(F.xxhash64("__start", "__last"), F.lit(_NO_MATCH)))
    numbers = F.when(hit, F.sequence(below + 1, F.col("__hi.entries"))).otherwise(nothing)
    side = entries.select(F.col("carrier").alias("__carrier"), F.col("rank").cast("bigint").alias("__rank"),
                          F.col("nb").alias("__nb"), F.col("same_before").alias("__same"))
    out = df.withColumns({"__below": below, "__number": F.explode(numbers)}).join(
        side, (F.lower(F.col(carrier)) == F.col("__carrier")) & (F.col("__number") == F.col("__rank")), "left")
    first_of_length = F.col("__same").isNull() | (F.col("__same") <= F.col("__below"))
    return out.where(first_of_length).withColumn(
        output, F.coalesce(F.col("__nb"), F.lit(0)).cast("double")).drop(
        "__below", "__number", "__carrier", "__rank", "__nb", "__same")
