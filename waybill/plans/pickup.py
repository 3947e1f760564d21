"""Pickup reports of the delivery marts and of the wide order table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import classify, codes
from ..functions.times import day, period_start, to_epoch
from ..operators import milestones as mst
from ..operators import pickup as pu


def schedule_facts(fulfilment: DataFrame, parcel: DataFrame, tracking: DataFrame,
                   requests: DataFrame, orders: DataFrame, spec: Mapping = mst.PICKUP,
                   carriers: Sequence[str] | None = (
                       codes.EXPRESS_CARRIER, codes.ECONOMY_CARRIER)) -> DataFrame:
    """Parcels with resolved schedule, milestones, state and order carrier."""
    head = parcel.select("log_id", "lm_tracking_no", "fulfillment_channel_id", "inbound_type",
                         "scheduled_pickup_timestamp", "parcel_logistics_status_code")
    link = fulfilment.select("log_id", "order_id", "order_arrange_shipping_timestamp")
    asked = requests.select("log_id", "pickup_time")
    joined = (
        mst.milestones(tracking, spec, listed_only=True).join(link, "log_id", "right")
        .join(head, "log_id", "left").join(asked, "log_id", "left")
    )
    facts = pu.pickup_schedule(joined).withColumn(
        "sls_status", classify.parcel_state("parcel_logistics_status_code"))
    place = orders.select("order_id", "fulfilment_shipping_carrier", "seller_state",
                          "seller_city", "buyer_state", "buyer_city")
    if carriers is not None:
        place = place.where(F.col("fulfilment_shipping_carrier").isin(*carriers))
    return facts.join(place, "order_id")


def _one_per_parcel(facts: DataFrame) -> DataFrame:
    """Rows that differ in nothing the report looks at count once."""
    return facts.select(
        "order_id", "lm_tracking_no", "fulfilment_shipping_carrier", "seller_state",
        "seller_city", "scheduled_date1", "shipment_type1", "pku_done_time", "pku_1st_time",
        "pku_failed_time", "gross_pickup_request", "gross_pickup_done", "gross_pickup_failed",
        "ontime_pickup_done", "ontime_pickup", "order_arrange_shipping_timestamp",
        "sls_status").distinct()


def campaign_pickup(facts: DataFrame, windows) -> DataFrame:
    """Pickup KPIs of campaign schedules per carrier."""
    scoped = _one_per_parcel(facts).where(
        (F.col("shipment_type1") == "pickup") & classify.in_campaign("scheduled_date1", windows))
    return pu.pickup_kpis(scoped, [
        classify.campaign_bucket("scheduled_date1", windows, "no").alias("cp"),
        "fulfilment_shipping_carrier"])


def monthly_pickup(facts: DataFrame, first: str, last: str) -> DataFrame:
    """Weekly pickup KPIs per carrier and seller city with the p95 contact gap."""
    scoped = _one_per_parcel(facts).where(
        (F.col("shipment_type1") == "pickup") & day("scheduled_date1").between(
            F.lit(first).cast("date"), F.lit(last).cast("date")))
    gap = (to_epoch("pku_done_time") - to_epoch("pku_1st_time")) / F.lit(86400)
    return pu.pickup_kpis(scoped, [
        period_start("scheduled_date1", "week").alias("week_start"),
        "fulfilment_shipping_carrier", "seller_state", "seller_city"], gap)


def pickup_gap(facts: DataFrame, first: str, last: str,
               states: Sequence[str] | None = None) -> DataFrame:
    """95th percentile of arrangement to first pickup attempt, in days."""
    scoped = _one_per_parcel(facts).where(
        (F.col("shipment_type1") == "pickup") & day("scheduled_date1").between(
            F.lit(first).cast("date"), F.lit(last).cast("date")))
    if states is not None:
        scoped = scoped.where(F.col("seller_state").isin(*states))
    gap = (to_epoch("pku_1st_time") - F.col("order_arrange_shipping_timestamp")) / F.lit(86400)
    return scoped.groupBy("fulfilment_shipping_carrier", "seller_state", "seller_city").agg(
        F.round(pu.percentile(gap, 0.95), 3).alias("gap_time"))


# --- wide order table ------------------------------------------------------------

def last_week(as_of: dt.date) -> tuple[dt.date, dt.date]:
    """Monday to Sunday of the week before."""
    monday = as_of - dt.timedelta(days=as_of.weekday())
    return monday - dt.timedelta(days=7), monday - dt.timedelta(days=1)


def weekly_success(df: DataFrame, as_of: dt.date, shift_days: int = 0) -> DataFrame:
    """Success share of last week; ``shift_days=1`` moves the window to
    Tuesday-Monday."""
    first, last = last_week(as_of)
    move = dt.timedelta(days=shift_days)
    return pu.weekly_region(df, as_of, pu.ontime_success(as_of), first + move, last + move)


def weekly_first_contact(df: DataFrame, as_of: dt.date) -> DataFrame:
    """First-contact share of last week (incident rule)."""
    return pu.weekly_region(df, as_of, pu.ontime_first_v2(as_of), *last_week(as_of))


def overall_first_contact(df: DataFrame, as_of: dt.date, first: dt.date,
                          last: dt.date) -> DataFrame:
    """Denominator, numerator and share over a range of days."""
    base = pu.daily_base(pu.in_scope(df, first, last), {"ok": pu.ontime_first_v2(as_of)})
    return base.agg(F.sum("orders").alias("total_orders"), F.sum("ok").alias("ontime_first"),
                    F.round(F.sum("ok") / F.nullif(F.sum("orders"), F.lit(0)), 4).alias("share"))


def order_check(df: DataFrame, as_of: dt.date, days: int, province: str | None = None,
                district: str | None = None) -> DataFrame:
    """Row-level on-time label of recent orders of one district."""
    rows = pu.in_scope(df, as_of - dt.timedelta(days=days), as_of - dt.timedelta(days=1),
                       keep_cancelled=False)
    if province is not None:
        rows = rows.where(F.col("fromprovince") == province)
    if district is not None:
        rows = rows.where(F.col("fromdistrict") == district)
    return rows.select(
        day("orderdate").alias("order_day"), "ordercode", pu.hub_group().alias("type_kh"),
        "fromprovince", "fromdistrict", "pickwh", "firstupdatedpickeduptime",
        "firstfailpicknote", "endpicktime", pu.ontime_label_v3().alias("is_ontime"))


def open_pickups(df: DataFrame, wards: DataFrame, provinces: Sequence[str] | None = None,
                 ) -> DataFrame:
    """Row-level list of orders still to be picked up, with ward names."""
    rows = pu.in_scope(df, keep_cancelled=False).where(
        F.col("currentstatus").isin(*codes.OPEN_PICKUP_STATUSES))
    if provinces is not None:
        rows = rows.where(F.col("fromprovince").isin(*provinces))
    names = wards.select(F.col("ward_id").alias("__ward"), "ward_name").distinct()
    return rows.join(names, F.col("fromwardcode") == F.col("__ward"), "left").select(
        day("orderdate").alias("order_day"), "ordercode", pu.hub_group().alias("type_kh"),
        "fromprovince", "fromdistrict", "ward_name", "pickwh", "currentstatus",
        "clientcontactname", "firstupdatedpickeduptime", "firstfailpicknote", "endpicktime",
        pu.ontime_label_v3().alias("is_ontime"))


def district_table(df: DataFrame, grain: str, as_of: dt.date, first: dt.date, last: dt.date,
                   version: int = 2) -> DataFrame:
    """Volumes and on-time counts per district, all days and Sundays."""
    table = pu.breakdown(df, grain, ["fromprovince", "fromdistrict"], as_of, first, last, version)
    return table.select("period", "time", "fromprovince", "fromdistrict", "volume_created",
                        "first_ok", "success_ok", "sunday", "sunday_ok")
