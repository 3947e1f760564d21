"""Delivery KPIs: due dates, on-time classes, roll-ups, lead times, periods."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import codes
from ..functions.times import day, due_date, due_date_midnight, iso_week
from . import histograms as hst


def flag_sum(condition: Column) -> Column:
    """Rows for which the condition holds; unknown counts as no."""
    return F.sum(F.when(condition, 1).otherwise(0))


def with_due_date(df: DataFrame, pickup: str, allowance: Column, output: str = "expected_delivery",
                  channel: str | None = None) -> DataFrame:
    """Adds the due date; with ``channel`` the carrier that counts to midnight
    gets the midnight rule."""
    plain = due_date(pickup, allowance)
    if channel is None:
        return df.withColumn(output, plain)
    return df.withColumn(output, F.when(
        F.col(channel) == codes.MIDNIGHT_DUE_CHANNEL, due_date_midnight(pickup, allowance)
    ).otherwise(plain))


def ontime_class(attempt, due) -> Column:
    """'Late', 'Ontime', or NULL when either date is unknown."""
    return F.when(day(attempt) > day(due), "Late").when(day(attempt) <= day(due), "Ontime")


def ontime_label(attempt, due) -> Column:
    return F.when(day(attempt) <= day(due), codes.ON_TIME_LABEL).otherwise(codes.LATE_LABEL)


def parcel_outcome(returned, delivered) -> Column:
    return (
        F.when(F.col(returned).isNotNull(), codes.STATE_RETURNED)
        .when(F.col(delivered).isNotNull(), codes.STATE_DELIVERED)
        .otherwise(codes.STATE_OPEN)
    )


def delivery_kpis(df: DataFrame, by: Sequence, pickup="pku_done_time", first="deli_1st_time",
                  done="deli_done_time", failed="deli_failed_time",
                  pending="dli_pending_tracking_time", due="expected_delivery") -> DataFrame:
    """Requests, on-time first attempts, deliveries, failures per group."""
    return df.groupBy(*by).agg(
        flag_sum(F.col(pickup).isNotNull()).alias("gross_deli_request"),
        flag_sum(day(first) <= day(due)).alias("gross_ontime_deli_1st"),
        flag_sum(F.col(done).isNotNull()).alias("gross_deli_done"),
        flag_sum(day(done) <= day(due)).alias("gross_ontime_deli_done"),
        flag_sum(F.col(failed).isNotNull()).alias("gross_failed"),
        flag_sum(F.col(done).isNotNull() & F.col(pending).isNull()).alias("gross_1st_deli_done"),
    )


def ontime_kpis(df: DataFrame, by: Sequence, check: str = "check_delivery_ontime") -> DataFrame:
    """Roll-up of classified parcels (all carriers)."""
    return df.groupBy(*by).agg(
        flag_sum(F.col("pickup_done_time").isNotNull()).alias("deli_request"),
        flag_sum(F.col("delivery_done_time").isNotNull()).alias("deli_done"),
        flag_sum(F.col(check) == "Ontime").alias("ontime_delivery"),
        flag_sum(F.col(check) == "Late").alias("late_delivery"),
        flag_sum(F.col("dli_pending_tracking_time").isNull()
                 & F.col("delivery_done_time").isNotNull()).alias("deli_done_1st_time"),
        flag_sum(F.col("delivery_failed").isNotNull()).alias("deli_failed"),
    )


def percentile(value, p: float, accuracy: int = 10000) -> Column:
    """Discrete percentile from a mergeable sketch (rank error 1/accuracy)."""
    return F.percentile_approx(value, p, accuracy)


def leadtime_stats(df: DataFrame, by: Sequence[str], leadtime: str = "deli_1st_leadtime",
                   parcel: str = "lm_tracking_no", digits: int = 1) -> DataFrame:
    """Mean, 80th and 95th percentile of the lead time and distinct parcels.

    Exact, from a counted histogram of the group; the facts are read once.
    """
    figures = hst.histogram_and_distinct(df.select(*by, leadtime, parcel), by, leadtime, parcel)
    return figures.select(
        *by, F.round(hst.mean(F.col("counts")), digits).alias("avg_time"),
        *hst.histogram_figures("counts", (80, 95), digits)[1:], F.col("items").alias("order_"))


def compare_periods(df: DataFrame, by: Sequence[str], periods: Mapping[str, tuple[str, str]],
                    date: str = "expected_delivery", leadtime: str = "deli_1st_leadtime",
                    digits: int = 1) -> DataFrame:
    """Lead time of several periods side by side, from one counted histogram.

    Every figure is taken from its own period only; the two sides are never
    joined on a coarse key, which would weight one period by the other's size.
    Periods may overlap.
    """
    inside = {n: _within(date, period) for n, period in periods.items()}
    any_period = F.lit(False)
    for i in inside.values():
        any_period = any_period | i
    flags = {n: f"__in_{n}" for n in periods}
    counted = hst.value_histogram(
        df.where(any_period).select(*by, leadtime, *[i.alias(flags[n]) for n, i in inside.items()]),
        [*by, *flags.values()], leadtime)
    grouped = counted.groupBy(*by).agg(
        *[hst.sorted_counts(leadtime, where=F.col(f)).alias(f) for f in flags.values()])
    return grouped.select(*by, *[c for n, f in flags.items() for c in hst.histogram_figures(f, (80, 95), digits, f"_{n}")])


def compare_periods_fanout(df: DataFrame, left: tuple[str, str], right: tuple[str, str],
                           match: str, by: Sequence[str], date: str = "expected_delivery",
                           leadtime: str = "deli_1st_leadtime", digits: int = 1) -> DataFrame:
    """The side-by-side comparison with the row weights of a join on ``match``.

    Joining every row of the first period with every second-period row of the
    same carrier gives figures in which the second period's side is the
    carrier's own average and percentile (each row repeated equally often).
    That is computed here directly, and the facts are read once: one counted
    histogram holds both periods, and a carrier's second period is put together
    from the histograms of its groups.  ``match`` is one of ``by``.
    """
    weeks = df.where(_within(date, left) | _within(date, right)).withColumn("week_", iso_week(date) + 1)
    counted = hst.value_histogram(
        weeks.select(*by, leadtime, _within(date, left).alias("__left"), _within(date, right).alias("__right")),
        [*by, "__left", "__right"], leadtime)
    grouped = counted.groupBy(*by).agg(
        hst.sorted_counts(leadtime, where=F.col("__left")).alias("__first"),
        hst.sorted_counts(leadtime, where=F.col("__right")).alias("__part"),
        F.max("__left").alias("__wanted"))
    # a group of unknown ``match`` would find no partner in the join
    part = F.when(F.col(match).isNotNull(), F.col("__part")).otherwise(F.slice("__part", 1, 0))
    whole = F.array_sort(F.flatten(F.collect_list(part).over(Window.partitionBy(match))))
    return grouped.withColumn("__second", whole).where("__wanted").select(
        *by, *hst.histogram_figures("__first", (80, 95), digits, "_1"),
        *hst.histogram_figures("__second", (80, 95), digits, "_2"))


def _within(date: str, period: tuple[str, str]) -> Column:
    return day(date).between(*[F.lit(d).cast("date") for d in period])


# --- backlog -----------------------------------------------------------------

def open_parcels(df: DataFrame, lost_state: int = 11) -> DataFrame:
    """Picked up, neither delivered nor returned, not lost."""
    return df.where(
        F.col("pku_done_tracking_time").isNotNull()
        & F.col("dli_done_tracking_time").isNull()
        & F.col("return_done_tracking_time").isNull()
        & (F.col("logistics_status_id") != lost_state)
    )


def age_days(pickup, as_of: dt.date) -> Column:
    """Whole days from pickup to the midnight of ``as_of``."""
    return F.timestamp_diff("DAY", F.col(pickup), F.lit(as_of).cast("timestamp"))


def aging_flags(pickup, as_of: dt.date, low: int, high: int, names: Sequence[str],
                low_inclusive: bool = True) -> dict[str, Column]:
    """Three 0/1 columns: young, middle, old."""
    age = age_days(pickup, as_of)
    young = age <= low if low_inclusive else age < low
    middle = ~young & (age <= high)
    return {
        n: F.when(c, 1).otherwise(0) for n, c in zip(names, (young, middle, age > high))
    }


def first_attempt_any() -> Column:
    return F.coalesce("dli_pending_tracking_time", "dli_done_tracking_time",
                      "return_pending_tracking_time", "return_done_tracking_time")


def backlog_by_area(df: DataFrame, by: Sequence[str], flags: Sequence[str],
                    parcel: str = "lm_tracking_no") -> DataFrame:
    """Aging sums and distinct open parcels per area."""
    return df.groupBy(*by).agg(
        *[F.sum(f).alias(f) for f in flags], F.count_distinct(parcel).alias("total_backlog"))


def pending_kind(area_state: str, pickup="pku_done_time", seller_state="seller_state",
                 status="logistics_status_id") -> Column:
    """'Pending pickup' for unpicked parcels of the area, else 'Pending Deli'."""
    return F.when(
        F.col(pickup).isNull() & (F.col(seller_state) == area_state) & (F.col(status) != 4),
        "Pending pickup",
    ).otherwise("Pending Deli")


def pending_in_area(df: DataFrame, state: str, city: str,
                    channels: Sequence[int] = (codes.EXPRESS_CHANNEL, codes.ECONOMY_CHANNEL),
                    ) -> DataFrame:
    """Parcels still to be picked up in, or delivered to, one city."""
    live = ~F.col("logistics_status_id").isin(7, 8, 10, 11)
    to_pick = (
        F.col("pku_done_time").isNull() & (F.col("seller_state") == state)
        & (F.col("seller_city") == city) & (F.col("logistics_status_id") != 4)
    )
    to_deliver = (
        (F.col("logistics_status_id") == 2) & (F.col("buyer_state") == state)
        & (F.col("buyer_city") == city)
    )
    return df.where(live & F.col("fulfilment_channel_id").isin(*channels)
                    & (to_pick | to_deliver))


def area_exposure(df: DataFrame, state: str, city: str, by: Sequence) -> DataFrame:
    """Orders per group that touch an area as seller or as buyer.

    An order counts when its own address pair has an end in the area.  The
    test is made on the row itself; matching rows against the list of such
    pairs would count a pair once per occurrence in the list.
    """
    from_area = (F.col("seller_state") == state) & (F.col("seller_city") == city)
    to_area = (F.col("buyer_state") == state) & (F.col("buyer_city") == city)
    complete = (F.col("seller_state").isNotNull() & F.col("seller_city").isNotNull()
                & F.col("buyer_state").isNotNull() & F.col("buyer_city").isNotNull())
    touched = complete & (from_area | to_area)
    return df.groupBy(*by).agg(
        flag_sum(touched).alias("touching"),
        flag_sum(complete & from_area).alias("as_seller"),
        flag_sum(complete & to_area).alias("as_buyer"),
    )


PAIR = ("seller_state", "seller_city", "buyer_state", "buyer_city")


def area_exposure_listed(df: DataFrame, listed: DataFrame,
                         by: Mapping[str, Column]) -> DataFrame:
    """Matches of each order with every occurrence of its address pair in
    ``listed``, as a join on the undistinct list counts them.

    Both sides are counted per address pair first and the counts multiplied,
    so no pair of rows is ever formed.
    """
    rows = df.groupBy(*[c.alias(n) for n, c in by.items()], *PAIR).agg(
        F.count(F.lit(1)).alias("__rows"))
    hits = listed.where(_complete_pair()).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("__hits"))
    matches = F.sum(F.coalesce(F.col("__rows") * F.col("__hits"), F.lit(0)))
    return rows.join(hits, list(PAIR), "left").groupBy(*by).agg(matches.alias("matches"))


def _complete_pair() -> Column:
    known = F.lit(True)
    for column in PAIR:
        known = known & F.col(column).isNotNull()
    return known
