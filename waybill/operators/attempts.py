"""Delivery and pickup attempts: ranked events, gaps, hours, suspicious cases."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import codes
from ..functions.times import REPORT_SHIFT, from_epoch, to_epoch

KEY = "log_id"


def _ranked(events: DataFrame, upto: int, key: str, reason: Column) -> DataFrame:
    """(key, second, reason, rnk) of the events ranked up to ``upto`` by time.

    Exact copies are collapsed and counted first, keyed by parcel, second and
    reason, so even a parcel with a third of the log is spread.  Only the
    ``upto`` earliest seconds of a parcel can hold such a rank; the dense_rank
    filter lets every task drop the rest before the shuffle, so a hot parcel
    sends a few rows per task.  The rank is one plus the events before.
    """
    counted = events.groupBy(
        key, F.col("actual_time").alias("second"), reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key).orderBy("second")
    top = counted.withColumn("pos", F.dense_rank().over(order)).where(F.col("pos") <= upto)
    earlier = F.sum("n").over(order.rangeBetween(Window.unboundedPreceding, -1))
    return top.select(key, "second", "reason", (F.coalesce(earlier, F.lit(0)) + 1).alias("rnk"))


def _events(tracking: DataFrame, column: str, wanted: Sequence[str],
            since: dt.date | None) -> DataFrame:
    events = tracking.where(F.col(column).isin(*wanted))
    if since is not None:
        events = events.where(from_epoch("actual_time", REPORT_SHIFT).cast("date") >= F.lit(since))
    return events


def nth_attempt(tracking: DataFrame, code: str | Sequence[str], n: int, key: str = KEY,
                reason: str | Column = "reason_description", column: str = "tracking_code",
                since: dt.date | None = None) -> DataFrame:
    """Distinct (parcel, reason, time) of the events ranked ``n`` by time.

    Equal times share a rank and the following ranks are skipped, so a tie may
    give several rows or none.
    """
    wanted = [code] if isinstance(code, str) else list(code)
    why = reason if isinstance(reason, Column) else F.col(reason)
    ranked = _ranked(_events(tracking, column, wanted, since), n, key, why)
    return ranked.where(F.col("rnk") == n).select(
        key, F.col("reason").alias("tracking_detail_reason"),
        from_epoch("second", REPORT_SHIFT).alias("tracking_time"), F.col("rnk").cast("int"))


def attempts_wide(tracking: DataFrame, code: str, upto: int = 3, prefix: str = "dli",
                  key: str = KEY, since: dt.date | None = None) -> DataFrame:
    """One row per parcel: time and reason of attempts 1..``upto``.

    One pass over the log replaces one ranked self-scan per attempt.  When
    events tie at a rank, the smallest reason text stands for it.
    """
    ranked = _ranked(_events(tracking, "tracking_code", [code], since), upto, key,
                     F.col("reason_description"))
    wide = ranked.groupBy(key).agg(*[
        agg for i in range(1, upto + 1) for agg in (
            F.min(F.when(F.col("rnk") == i, F.col("second"))).alias(f"{prefix}_{i}_time"),
            F.min(F.when(F.col("rnk") == i, F.col("reason"))).alias(f"{prefix}_{i}_reason"),
        )])
    return wide.select(key, *[
        c for i in range(1, upto + 1) for c in (
            from_epoch(f"{prefix}_{i}_time", REPORT_SHIFT).alias(f"{prefix}_{i}_time"),
            F.col(f"{prefix}_{i}_reason"),
        )])


def attempt_count(prefix: str = "dli") -> Column:
    """1, 2 or 3; parcels without any attempt also count as 1."""
    second, third = F.col(f"{prefix}_2_time"), F.col(f"{prefix}_3_time")
    return F.when(second.isNull(), 1).when(third.isNull(), 2).otherwise(3)


def attempt_gap_class(prefix: str = "dli") -> Column:
    """How far apart consecutive attempts are, worst finding first."""
    times = [F.col(f"{prefix}_{i}_time") for i in (1, 2, 3)]
    pairs = list(zip(times, times[1:]))

    def any_pair(test) -> Column:
        (a, b), (c, d) = pairs
        return test(a, b) | test(c, d)

    return (
        F.when(any_pair(lambda a, b: to_epoch(b) - to_epoch(a) < 900), codes.GAP_TWICE_15_MIN)
        .when(any_pair(lambda a, b: (F.hour(a) < 13) & (F.hour(b) > 12)),
              codes.GAP_MORNING_AFTERNOON)
        .when(any_pair(lambda a, b: to_epoch(b) - to_epoch(a) < 18000), codes.GAP_INVALID)
        .otherwise(codes.GAP_VALID)
    )


def abnormal_hour(prefix: str = "dli", check_third_evening: bool = True) -> Column:
    """Any attempt after 21:59 or before 06:00.

    ``check_third_evening=False`` leaves the evening of the third attempt out.
    """
    tests = []
    for i in (1, 2, 3):
        hour = F.hour(F.col(f"{prefix}_{i}_time"))
        if i < 3 or check_third_evening:
            tests.append(hour > 21)
        tests.append(hour < 6)
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return F.when(found, codes.HOUR_ABNORMAL).otherwise(codes.HOUR_NORMAL)


def pending_hour(ts) -> Column:
    hour = F.hour(ts)
    return (
        F.when(hour > 21, codes.HOUR_LATE).when(hour < 6, codes.HOUR_EARLY)
        .otherwise(codes.HOUR_NORMAL)
    )


def fake_attempts(wide: DataFrame, pattern: str = codes.CUSTOMER_FAULT,
                  prefix: str = "dli") -> DataFrame:
    """Parcels with two or three attempts none of which was the customer's fault.

    A missing reason is unknown, not blameless, and drops the parcel.
    """
    blameless = [~F.col(f"{prefix}_{i}_reason").rlike(pattern) for i in (1, 2, 3)]
    two = F.col(f"{prefix}_3_time").isNull() & blameless[0] & blameless[1]
    return wide.where((blameless[0] & blameless[1] & blameless[2]) | two)
