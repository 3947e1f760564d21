"""Delivery reports, composed from the operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify, codes
from ..functions.times import (
    day, elapsed, gap_days, iso_week, leadtime_days, month_label, months_before, period_start, sundays_between,
)
from ..operators import attempts as att
from ..operators import delivery as dlv
from ..operators import milestones as mst
from ..operators.orders import multi_parcel
from ..operators.sla import holiday_days, route_lookup, sla_days, sla_days_multi
from ..sources.marts import single_order_sn
from ..sources.scans import Scope

BOTH = (codes.EXPRESS_CHANNEL, codes.ECONOMY_CHANNEL)


def parcel_facts(orders: DataFrame, fulfilment: DataFrame, parcel: DataFrame,
                 tracking: DataFrame, spec: Mapping = mst.DELIVERY,
                 channels: Sequence[int] | None = BOTH,
                 order_columns: Sequence[str] = (), parcel_columns: Sequence[str] = (),
                 fulfilment_columns: Sequence[str] = (), keep_id: bool = False,
                 scope: Scope | None = None) -> DataFrame:
    """Distinct parcels with order addresses and milestones.

    Milestones, parcels and fulfilment rows are all keyed by parcel, so they
    meet in the partitioning the milestone aggregate already has; the order
    table is the only other shuffle.  Orders that travel under one tracking
    number from and to the same addresses give one row (``keep_id`` keeps
    parcels with different ids apart).  ``scope`` restricts the marts to their
    snapshot, the orders and the log to a range of partitions.
    """
    if scope is not None:
        orders, tracking = scope.orders(orders), scope.log(tracking)
        fulfilment, parcel = scope.snapshot(fulfilment), scope.snapshot(parcel)
    if channels is not None:
        parcel = parcel.where(F.col("fulfillment_channel_id").isin(*channels))
    head = parcel.select("log_id", "lm_tracking_no", "fulfillment_channel_id",
                         "lm_shipment_company", *parcel_columns)
    link = fulfilment.select("log_id", "order_id", *fulfilment_columns)
    place = orders.select("order_id", "seller_state", "seller_city", "buyer_state", "buyer_city",
                          "buyer_district", *order_columns)
    times = mst.milestones(tracking, spec, listed_only=True)
    facts = times.join(head.join(link, "log_id"), "log_id", "right").join(place, "order_id")
    return facts.drop("order_id", *([] if keep_id else ["log_id"])).distinct()


def with_allowance(facts: DataFrame, sla: DataFrame, extend: DataFrame,
                   routes: DataFrame | None, calendar: DataFrame, bonus: float = 0.0,
                   holiday_mode: str = "rows", pickup: str = "pku_done_time",
                   first: str = "deli_1st_time",
                   carrier: str = "lm_shipment_company") -> DataFrame:
    """Adds carrier, route, service level, Sundays, holidays and due date.

    ``routes=None`` keeps the route the facts already carry (for instance from
    :func:`~waybill.operators.sla.region_route`).  ``carrier`` is the column
    the holiday calendar is matched by.
    """
    df = facts if routes is None else route_lookup(facts, routes)
    df = sla_days(df, sla, extend, "fulfillment_channel_id", bonus)
    df = df.withColumns({
        "shipping_carrier": classify.two_carrier_label("fulfillment_channel_id"),
        "d_sundays": sundays_between(pickup, first),
    })
    df = holiday_days(df, calendar, carrier, F.col(pickup), day(first), mode=holiday_mode)
    return dlv.with_due_date(
        df, pickup, F.col("sla") + F.col("d_sundays") + F.col("d_holidays"))


def _due_between(df: DataFrame, first: str, last: str) -> DataFrame:
    return df.where(day("expected_delivery").between(
        F.lit(first).cast("date"), F.lit(last).cast("date")))


def campaign_delivery(base: DataFrame, windows) -> DataFrame:
    """Delivery KPIs of campaign due dates by carrier, city and route."""
    scoped = base.where(classify.in_campaign("expected_delivery", windows))
    return dlv.delivery_kpis(scoped, [
        classify.campaign_bucket("expected_delivery", windows).alias("cp"),
        "shipping_carrier", "buyer_state", "buyer_city", "route"])


def weekly_delivery(base: DataFrame, first: str, last: str) -> DataFrame:
    """Delivery KPIs per due week, carrier, city and route."""
    return dlv.delivery_kpis(_due_between(base, first, last), [
        period_start("expected_delivery", "week").alias("week_start"),
        iso_week("expected_delivery").alias("week_"),
        "shipping_carrier", "buyer_state", "buyer_city", "route"])


def monthly_volume_by_route(base: DataFrame, first: str, last: str) -> DataFrame:
    """Parcels per due month and route."""
    return _due_between(base, first, last).groupBy(
        month_label("expected_delivery").alias("month_"), "route",
    ).agg(F.count("lm_tracking_no").alias("vol"))


def monthly_sla_check(base: DataFrame, first: str, last: str,
                      states: Sequence[str] | None = None) -> DataFrame:
    """Delivery KPIs per due month, buyer state and route."""
    scoped = _due_between(base, first, last)
    if states is not None:
        scoped = scoped.where(F.col("buyer_state").isin(*states))
    return dlv.delivery_kpis(scoped, [
        month_label("expected_delivery").alias("month_"), "buyer_state", "route"])


def delivery_detail(base: DataFrame, first: str, last: str) -> DataFrame:
    """Row-level counterpart of the weekly KPIs with readable labels."""
    scoped = _due_between(base, first, last)
    return scoped.select(
        iso_week("expected_delivery").alias("week_"), "shipping_carrier", "lm_tracking_no",
        "seller_state", "seller_city", "buyer_state", "buyer_city", "route",
        dlv.ontime_label("deli_1st_time", "expected_delivery").alias("check_late"),
        dlv.parcel_outcome("deli_failed_time", "deli_done_time").alias("check_outcome"),
        "pku_done_time", day("deli_1st_time").alias("first_delivery_day"),
        day("expected_delivery").alias("due_day"), "sla", "d_sundays", "d_holidays")


def contact_detail(base: DataFrame, first: str, last: str,
                   states: Sequence[str] | None = None) -> DataFrame:
    """Delivered parcels with first-contact, first-try, return and gap labels."""
    scoped = base.where(day("deli_done_time").between(
        F.lit(first).cast("date"), F.lit(last).cast("date")))
    if states is not None:
        scoped = scoped.where(F.col("buyer_state").isin(*states))
    lead = gap_days("pku_done_time", "deli_1st_time", 1)
    done = F.col("deli_done_time").isNotNull()
    keys = {
        "shipping_carrier": F.col("shipping_carrier"), "lm_tracking_no": F.col("lm_tracking_no"),
        "buyer_state": F.col("buyer_state"), "buyer_city": F.col("buyer_city"),
        "buyer_district": F.col("buyer_district"),
        "expected_delivery": F.col("expected_delivery"),
        "deli_1st_time": F.col("deli_1st_time"), "deli_done_time": F.col("deli_done_time"),
        "deli_failed_time": F.col("deli_failed_time"),
        "first_contact": F.when(lead <= F.col("sla"), codes.FIRST_ON_TIME).otherwise(
            codes.FIRST_LATE),
        "first_try": F.when(done & F.col("dli_pending_tracking_time").isNull(),
                            codes.FIRST_TRY_OK).otherwise(codes.FIRST_TRY_NOT_OK),
        "returned": F.when(F.col("deli_failed_time").isNotNull(), codes.RETURN_OK).otherwise(
            codes.RETURN_NONE),
        "delivered": F.when(done, codes.DELIVERY_OK).otherwise(codes.DELIVERY_NOT_OK),
    }
    return scoped.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        F.avg(lead).alias("gap_time"))


def deep_dive(base: DataFrame, wide: DataFrame) -> DataFrame:
    """Row-level parcels with value, weight, payment, hour and attempt classes.

    ``base`` carries ``log_id``, ``gmv``, ``parcel_chargeable_weight`` and
    ``payment_method``; ``wide`` is one row of attempts per parcel.
    """
    joined = base.join(wide, "log_id", "left")
    return joined.select(
        "lm_tracking_no", "shipping_carrier", "seller_state", "seller_city", "buyer_state",
        "buyer_city", "route", classify.weight_bucket("parcel_chargeable_weight").alias(
            "actual_weight"),
        classify.value_bucket("gmv").alias("grand_total"),
        classify.payment_type().alias("payment_method"),
        att.pending_hour("dli_pending_tracking_time").alias("delivery_hour"),
        att.attempt_gap_class().alias("attempt_gap"))


# --- lead times ----------------------------------------------------------------

def leadtime_by_route(base: DataFrame, first: str, last: str, digits: int = 1) -> DataFrame:
    """Mean, p80, p95 of pickup-to-first-attempt and parcels per carrier and route."""
    lead = base.withColumn("deli_1st_leadtime", gap_days("pku_done_time", "deli_1st_time", 1))
    return dlv.leadtime_stats(
        _due_between(lead, first, last), ["shipping_carrier", "route"], digits=digits)


def leadtime_two_periods(base: DataFrame, left, right, faithful: bool = False,
                         digits: int = 1) -> DataFrame:
    """Two due periods side by side per carrier and buyer state."""
    lead = base.withColumn("deli_1st_leadtime", gap_days("pku_done_time", "deli_1st_time", 1))
    if faithful:
        return dlv.compare_periods_fanout(
            lead, left, right, "shipping_carrier", ["week_", "shipping_carrier", "buyer_state"],
            digits=digits)
    return dlv.compare_periods(
        lead, ["shipping_carrier", "buyer_state"], {"1": left, "2": right}, digits=digits)


# --- all carriers --------------------------------------------------------------

def all_carrier_base(resolved: DataFrame, orders: DataFrame, oms: DataFrame,
                     warehouse: DataFrame, routes: DataFrame, as_of: dt.date | None = None,
                     months: int = 6) -> DataFrame:
    """Resolved parcels with origin, carrier names and route.

    With ``as_of``, only parcels first attempted in the ``months`` months up to
    that day; the bound is applied before the parcels meet any other table.
    """
    if as_of is not None:
        resolved = resolved.where(day("first_attempt_delivery_time").between(
            F.lit(months_before(as_of, months)), F.lit(as_of)))
    multi = multi_parcel(oms, "order_id", "forder_id", F.col("whs_id").isNotNull())
    depot = oms.select(F.col("forder_id").alias("oms_forder_id"), F.col("whs_id").alias("__w"))
    places = warehouse.select(F.col("whs_id").alias("__w"), F.col("state").alias("wh_state"),
                              F.col("city").alias("wh_city"))
    head = orders.where(F.col("is_cb_shop") == 0).select(
        "order_id", "is_cb_shop", "seller_state", "seller_city", "buyer_state", "buyer_city",
        "buyer_district", "fulfilment_shipping_carrier", "fulfilment_channel_id")
    scoped = resolved.where(
        F.col("first_attempt_delivery_time").isNotNull()
        & ~F.col("fulfillment_channel_id").isin(*codes.UNALLOCATED_CHANNELS)
    ).drop("seller_address_state")
    joined = (
        scoped.join(head, "order_id")
        .join(multi, "order_id", "left")
        .join(depot, "oms_forder_id", "left").join(places, "__w", "left")
    )
    is_multi = F.col("nb_parcels").isNotNull()
    routed = route_lookup(joined, routes)
    return routed.withColumns({
        "seller_state": classify.origin_address("state", "seller_state", "wh_state", is_multi),
        "seller_city": classify.origin_address("city", "seller_city", "wh_city", is_multi),
        "tpl_name": classify.tpl_name(), "tpl_call": classify.tpl_call(),
        "client_channel_id": F.col("fulfillment_channel_id"),
        "delivery_failed": F.col("failed_delivery_time"),
    }).drop("__w", "wh_state", "wh_city", "nb_parcels")


def all_carrier_classified(base: DataFrame, sla: DataFrame, sla_two: DataFrame,
                           extend: DataFrame, extend_area: DataFrame,
                           calendar: DataFrame) -> DataFrame:
    """Service level, due date and on-time class of every parcel."""
    df = sla_days_multi(base, sla, sla_two, extend, extend_area)
    df = holiday_days(df, calendar, "tpl_call", F.col("pickup_done_time"),
                      day("first_attempt_delivery_time"))
    df = df.withColumn("d_sundays", sundays_between("pickup_done_time",
                                                    "first_attempt_delivery_time"))
    allowance = F.col("total_sla") + F.col("d_sundays") + F.col("d_holidays")
    df = dlv.with_due_date(df, "pickup_done_time", allowance, channel="client_channel_id")
    return df.withColumn("check_delivery_ontime", dlv.ontime_class(
        "first_attempt_delivery_time", "expected_delivery"))


CLASSIFIED_ROW = (
    "lm_tracking_no", "pickup_done_time", "buyer_state", "buyer_city", "tpl_call",
    "first_attempt_delivery_time", "delivery_done_time", "delivery_failed",
    "dli_pending_tracking_time", "check_delivery_ontime", "route", "expected_delivery")


def yearly_all_carriers(classified: DataFrame, first: str, last: str,
                        carriers: Sequence[str] | None = None) -> DataFrame:
    """On-time roll-up per due month, city, carrier and route."""
    scoped = _due_between(classified, first, last)
    if carriers is not None:
        scoped = scoped.where(F.col("tpl_call").isin(*carriers))
    rows = scoped.select(*CLASSIFIED_ROW).distinct()
    return dlv.ontime_kpis(rows, [
        period_start("expected_delivery", "month").alias("month_start"), "buyer_state",
        "buyer_city", "tpl_call", "route"])


def all_carrier_detail(classified: DataFrame, first: str, last: str) -> DataFrame:
    """Row-level counterpart of the yearly roll-up."""
    return _due_between(classified, first, last).select(
        iso_week("expected_delivery").alias("week_"), *CLASSIFIED_ROW).distinct()


# --- attempts, backlog, pending --------------------------------------------------

def attempts_report(orders: DataFrame, parcel: DataFrame, tracking: DataFrame,
                    failed_first: str, failed_last: str,
                    carriers: Sequence[str] = (codes.EXPRESS_CARRIER, codes.ECONOMY_CARRIER),
                    status: int | None = 6, since: dt.date | None = None,
                    check_third_evening: bool = True) -> DataFrame:
    """Failed parcels whose attempts look fake, with attempt classes.

    One pass collects pickup and failure times, one the delivery attempts.
    """
    times = mst.milestones(tracking, {
        "pickup_done": mst.Milestone(("F100",), "actual"),
        "failed": mst.Milestone(codes.RETURNED, "actual"),
    }, listed_only=True)
    times = times.where(F.to_date("failed").between(
        F.lit(failed_first).cast("date"), F.lit(failed_last).cast("date")))
    wide = att.attempts_wide(tracking, "F650", 3, since=since)
    head = orders.where(F.col("fulfilment_shipping_carrier").isin(*carriers))
    if status is not None:
        head = head.where(F.col("logistics_status_id") == status)
    head = head.select("order_id", "order_sn", "create_timestamp", "buyer_state", "buyer_city",
                       "buyer_district")
    link = single_order_sn(parcel).select(
        "order_sn", "log_id", "lm_tracking_no", "consignment_no")
    joined = att.fake_attempts(times.join(wide, "log_id")).join(link, "log_id").join(
        head, "order_sn")
    return joined.select(
        "order_sn", "order_id", "lm_tracking_no", "consignment_no",
        F.timestamp_seconds(F.col("create_timestamp") - 3600).alias("created_datetime"),
        "buyer_state", "buyer_city", "buyer_district", "pickup_done",
        *[f"dli_{i}_time" for i in (1, 2, 3)], *[f"dli_{i}_reason" for i in (1, 2, 3)],
        att.attempt_count().alias("attempt_count"), att.attempt_gap_class().alias("attempt_gap"),
        att.abnormal_hour(check_third_evening=check_third_evening).alias("attempt_hour"))


def _open_with_order(orders: DataFrame, parcel: DataFrame, tracking: DataFrame,
                     carriers: Sequence[str] | None, parcel_columns=()) -> DataFrame:
    times = mst.milestones(tracking, mst.BACKLOG, listed_only=True)
    link = single_order_sn(parcel).select("order_sn", "log_id", "lm_tracking_no", *parcel_columns)
    head = orders.select("order_sn", "create_timestamp", "fulfilment_shipping_carrier",
                         "logistics_status", "logistics_status_id", "buyer_state", "buyer_city",
                         "buyer_district")
    if carriers is not None:
        head = head.where(F.col("fulfilment_shipping_carrier").isin(*carriers))
    return dlv.open_parcels(times.join(link, "log_id").join(head, "order_sn"))


def backlog_detail(orders: DataFrame, parcel: DataFrame, tracking: DataFrame, as_of: dt.date,
                   created_after: str, carriers: Sequence[str] | None = None) -> DataFrame:
    """Open parcels with last-mile hub and aging flags (up to 6, 7-11, over 11 days)."""
    rows = _open_with_order(orders, parcel, tracking, carriers)
    rows = rows.where(F.to_date(F.timestamp_seconds(F.col("create_timestamp") - 3600))
                      > F.lit(created_after).cast("date"))
    rows = rows.join(mst.hub_arrival(tracking), "log_id", "left")
    flags = dlv.aging_flags("pku_done_tracking_time", as_of, 6, 11,
                            ["aging_6_days", "aging_6_11_days", "aging_12_days"])
    return rows.select(
        "lm_tracking_no", "fulfilment_shipping_carrier", "buyer_state", "buyer_city",
        "buyer_district", "lm_hub", "lm_hub_ib_time", "pku_done_tracking_time",
        dlv.first_attempt_any().alias("first_delivery_attempt"),
        *[c.alias(n) for n, c in flags.items()]).distinct()


def backlog_dashboard(orders: DataFrame, parcel: DataFrame, tracking: DataFrame,
                      as_of: dt.date, carriers: Sequence[str] | None = None,
                      days: int = 10, status: str | None = "PICKUP DONE") -> DataFrame:
    """Open forward parcels per buyer city with aging (under 5, 5-7, over 7 days)."""
    rows = _open_with_order(orders, parcel.where(F.col("is_reverse") == 0), tracking, carriers)
    if status is not None:
        rows = rows.where(F.col("logistics_status") == status)
    rows = rows.where(F.to_date("pku_done_tracking_time").between(
        F.lit(as_of - dt.timedelta(days=days)), F.lit(as_of)))
    names = ["aging_5_days", "aging_5_7_days", "aging_7_days"]
    flags = dlv.aging_flags("pku_done_tracking_time", as_of, 5, 7, names, low_inclusive=False)
    rows = rows.select(
        "lm_tracking_no", "fulfilment_shipping_carrier", "buyer_state", "buyer_city",
        "pku_done_tracking_time", dlv.first_attempt_any().alias("first_delivery_attempt"),
        "logistics_status", *[c.alias(n) for n, c in flags.items()]).distinct()
    return dlv.backlog_by_area(rows, ["buyer_state", "buyer_city"], names)


def leadtime_gap_detail(facts: DataFrame, arranged: str = "order_arrange_shipping_timestamp",
                        ) -> DataFrame:
    """Created, pickup, delivery times and the gaps between them in days."""
    created = F.timestamp_seconds(arranged)
    return facts.select(
        "lm_tracking_no", "shipping_carrier", "seller_state", "seller_city", "buyer_state",
        "buyer_city", created.alias("created_time"), "pku_1st_time", "pku_done_time",
        "deli_1st_time", "deli_done_time",
        gap_days(created, "pku_1st_time").alias("gap_created_to_first_pu"),
        gap_days("pku_1st_time", "pku_done_time").alias("gap_first_pu_to_pu_done"),
        gap_days("pku_done_time", "deli_1st_time").alias("gap_pu_done_to_first_deli"),
        gap_days("deli_1st_time", "deli_done_time").alias("gap_first_deli_to_deli_done"))


def leadtime_columns() -> dict[str, Column]:
    """Whole-day lead times to delivery and to the first attempt."""
    return {
        "deli_done_leadtime": leadtime_days("pku_done_time", "deli_done_time"),
        "deli_1st_leadtime": leadtime_days("pku_done_time", "deli_1st_time"),
        "deli_done_hours": elapsed("hour", F.col("pku_done_time"), F.col("deli_done_time")),
    }


def area_report(orders: DataFrame, state: str, city: str, as_of: dt.date, days: int = 60,
                faithful: bool = False) -> DataFrame:
    """Orders of the last days per creation week and carrier that touch a city.

    ``faithful`` counts an order once per occurrence of its address pair among
    all orders of the area, as matching against the undistinct list does.
    """
    created = F.timestamp_seconds(F.col("create_timestamp") - 3600)
    recent = orders.where(F.to_date(created).between(
        F.lit(as_of - dt.timedelta(days=days)), F.lit(as_of)))
    by = {"week_": iso_week(created), "carrier": classify.area_carrier_label()}
    if not faithful:
        return dlv.area_exposure(recent, state, city, [c.alias(n) for n, c in by.items()])
    touching = orders.where(
        ((F.col("seller_state") == state) & (F.col("seller_city") == city))
        | ((F.col("buyer_state") == state) & (F.col("buyer_city") == city)))
    return dlv.area_exposure_listed(recent, touching, by)
