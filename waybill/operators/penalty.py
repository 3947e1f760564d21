"""Carrier penalties: limits from service levels, weekends and holidays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import codes
from ..functions.times import day, elapsed_days_real, iso_dow, noon_adjust, weekend_allowance


def adjusted_clocks(df: DataFrame) -> DataFrame:
    """Adds the noon-adjusted pickup and return start."""
    return df.withColumns({
        "adjusted_pickup": noon_adjust("sls_pickup_done"),
        "adjusted_return": noon_adjust("sls_return_time"),
    })


def lead_times(df: DataFrame) -> DataFrame:
    """Adds weekday numbers, weekend allowances and the four real lead times."""
    out = {}
    for role, start in (("delivery", "adjusted_pickup"), ("return", "adjusted_return")):
        out[f"day_of_week_{role}"] = iso_dow(start).cast("double") + 1
        out[f"{role}_w_weekend"] = weekend_allowance(
            start, "total_sla", codes.WEEKEND_DIVISOR)
    done, failed = F.col("sls_delivery_done"), F.col("sls_del_failed")
    ends = {
        "del_leadtime": ("adjusted_pickup", F.coalesce("sls_first_delivery_attempt", done)),
        "del_leadtime_overall": ("adjusted_pickup", F.coalesce("sls_return_time", done)),
        "return_leadtime": ("adjusted_return", F.coalesce("sls_first_return_attempt", failed)),
        "return_leadtime_overall": ("adjusted_return", failed),
    }
    for name, (start, end) in ends.items():
        out[name] = elapsed_days_real(start, end)
    return df.withColumns(out)


def holiday_windows(overall_days: int, sla_end_delivery: Column,
                    sla_end_return: Column) -> dict[str, tuple[str, Column, Column]]:
    """The four holiday columns: service-level and overall window, both ways."""
    pickup, back = F.col("adjusted_pickup"), F.col("adjusted_return")
    return {
        "nb_delivery_holiday": ("delivery", pickup, sla_end_delivery),
        "nb_return_holiday": ("return", back, sla_end_return),
        "nb_delivery_holiday_overall": ("delivery", pickup, F.date_add(day(pickup), overall_days)),
        "nb_return_holiday_overall": ("return", back, F.date_add(day(back), overall_days)),
    }


def penalties(df: DataFrame, overall_days: int, keep_all: bool = False) -> DataFrame:
    """Adds limits, the five penalty labels and the final label.

    50 %: late pickup (not for drop-offs), delivery or return beyond its limit.
    100 %: end-to-end beyond ``overall_days`` plus holidays and remote days;
    it replaces the 50 % label of the same direction.  Only flagged parcels are
    kept unless ``keep_all``.
    """
    def label(test: Column, text: str) -> Column:
        return F.when(test, text).otherwise("")

    limits = df.withColumns({
        "limit_leadtime_delivery":
            F.col("total_sla") + F.col("delivery_w_weekend") + F.col("nb_delivery_holiday"),
        "limit_leadtime_return":
            F.col("total_sla") + F.col("return_w_weekend") + F.col("nb_return_holiday"),
        "total_leadtime_delivery":
            F.lit(overall_days) + F.col("nb_delivery_holiday") + F.col("added_leadtime"),
        "total_leadtime_return":
            F.lit(overall_days) + F.col("nb_return_holiday") + F.col("added_leadtime"),
    })
    late_pickup = (day("sls_first_pickup_attempt") > day("fe_schedule_pickup")) & (
        F.col("is_dropoff") == 0)
    overall = {
        way: F.lit(overall_days) + F.col(f"nb_{way}_holiday_overall") + F.col("added_leadtime")
        for way in ("delivery", "return")
    }
    flagged = limits.withColumns({
        "is_delay_pickup": label(late_pickup, codes.PICKUP_LATE),
        "is_delay_delivery": label(
            F.col("del_leadtime") > F.col("limit_leadtime_delivery"), codes.DELIVERY_LATE),
        "is_delay_return": label(
            F.col("return_leadtime") > F.col("limit_leadtime_return"), codes.RETURN_LATE),
        "is_delay_delivery_overall": label(
            F.col("del_leadtime_overall") > overall["delivery"], codes.DELIVERY_LATE_OVERALL),
        "is_delay_return_overall": label(
            F.col("return_leadtime_overall") > overall["return"], codes.RETURN_LATE_OVERALL),
    })

    def final(way: str) -> Column:
        whole = F.col(f"is_delay_{way}_overall")
        return F.when(whole != "", whole).otherwise(F.col(f"is_delay_{way}"))

    out = flagged.withColumn(
        "final_penalty", F.concat("is_delay_pickup", final("delivery"), final("return")))
    return out if keep_all else out.where(F.col("final_penalty") != "")
