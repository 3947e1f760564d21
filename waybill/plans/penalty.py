"""Penalty sheets of the economy and the express carrier."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions import codes
from ..functions.classify import is_dropoff
from ..functions.times import REPORT_SHIFT, day, epoch_from, from_epoch
from ..operators import orders as ord_
from ..operators import penalty as pen
from ..operators.sla import holidays_in_windows, remote_addon, sla_express, sla_region


def penalty_base(orders: DataFrame, logistic: DataFrame, requests: DataFrame, times: DataFrame,
                 oms: DataFrame, warehouse: DataFrame, channel: int,
                 multi_with_warehouse_only: bool, created_since: dt.date | None = None) -> DataFrame:
    """Orders of one channel with milestones, terminal dates and real origin.

    ``created_since`` keeps orders created on that day or later; the bound is
    on the stored timestamp, so the scan of the order table can skip.
    """
    if created_since is not None:
        orders = orders.where(epoch_from("create_timestamp", created_since, REPORT_SHIFT))
    head = orders.where(
        (F.col("is_cb_shop") == 0) & (F.col("fulfilment_channel_id") == channel)
    ).withColumns(ord_.terminal_times()).select(
        "order_id", "order_sn", "fulfilment_shipping_carrier", "shop_id", "seller_id",
        "buyer_id", "buyer_paid_shipping_fee", "estimate_shipping_fee",
        F.col("actual_shipping_fee").alias("be_asf"), "logistics_status", "be_delivered_time",
        "be_delivery_failed_lost_time", "seller_state", "seller_city", "seller_district",
        "buyer_state", "buyer_city", "buyer_district")
    request = logistic.select(
        F.col("slo_id").alias("log_id"), F.col("ordersn").alias("order_sn"),
        F.col("slo_tn").alias("consignment"), "lm_tracking_number", "forderid",
        F.col("actual_shipping_fee").alias("sls_asf"))
    only = F.col("whs_id").isNotNull() if multi_with_warehouse_only else None
    multi = ord_.multi_parcel(oms, "order_id", "forder_id", only)
    unit = oms.select(
        F.col("forder_id").cast("string").alias("forderid"), F.col("whs_id").alias("__w"),
        (F.col("origin_shipping_fee").try_cast("double") / 100000).alias("sls_esf"),
        from_epoch("arranged_time", REPORT_SHIFT).alias("multi_arranged_time"),
        from_epoch("delivered_time").alias("multi_delivered_time"),
        (F.get_json_object("attributes", "$.chargeable_weight").try_cast("double") / 1000).alias(
            "order_weight"))
    depot = warehouse.select(F.col("whs_id").alias("__w"), F.col("state").alias("wh_state"),
                             F.col("city").alias("wh_city"), F.col("district").alias("wh_district"))
    joined = (
        times.join(requests.select("log_id", "pickup_time"), "log_id", "left")
        .join(request, "log_id", "right")
        .withColumn("forderid", F.col("forderid").cast("string"))
        # All that hangs on the parcel is joined before the orders, so that the many orders
        # without a parcel never meet in one null key.
        .join(unit, "forderid", "left").join(depot, "__w", "left")
        .join(head, "order_sn", "right")
        .join(multi, "order_id", "left")
    )
    is_multi = F.col("nb_parcels").isNotNull()
    origin = {
        f"seller_{part}": F.when(is_multi, F.col(f"wh_{part}")).otherwise(F.col(f"seller_{part}"))
        for part in ("state", "city", "district")
    }
    return pen.adjusted_clocks(joined.withColumns({
        **origin,
        "is_multi_parcel": is_multi.cast("int"),
        "fe_schedule_pickup": from_epoch("pickup_time", REPORT_SHIFT),
        "is_dropoff": is_dropoff("pickup_time"),
    })).drop("__w", "wh_state", "wh_city", "wh_district", "nb_parcels", "pickup_time")


def economy_penalty(base: DataFrame, regions: DataFrame, route: DataFrame, remote: DataFrame,
                    calendar: DataFrame, keep_all: bool = False,
                    overall_days: int = codes.ECONOMY_OVERALL_DAYS) -> DataFrame:
    """Region-pair service level, limits and penalties."""
    df = sla_region(base, regions, route)
    df = remote_addon(df.withColumn("total_sla", F.col("sla").try_cast("double")), remote)
    df = pen.lead_times(df)
    whole = F.floor(F.col("total_sla") + 0.5).cast("int")
    df = holidays_in_windows(df, calendar, "fulfilment_shipping_carrier", pen.holiday_windows(
        overall_days, F.date_add(day("adjusted_pickup"), whole),
        F.date_add(day("adjusted_return"), whole)))
    return pen.penalties(df, overall_days, keep_all)


def express_penalty(base: DataFrame, areas: DataFrame, route: DataFrame, rural: DataFrame,
                    remote: DataFrame, calendar: DataFrame, keep_all: bool = False,
                    overall_days: int = codes.EXPRESS_OVERALL_DAYS) -> DataFrame:
    """Express service level with rural add-ons, limits and penalties."""
    df = remote_addon(sla_express(base, areas, route, rural), remote)
    df = pen.lead_times(df)
    hours = F.make_dt_interval(hours=F.col("window_hours").cast("int"))
    df = holidays_in_windows(df, calendar, "fulfilment_shipping_carrier", pen.holiday_windows(
        overall_days, F.col("adjusted_pickup") + hours, F.col("adjusted_return") + hours))
    return pen.penalties(df, overall_days, keep_all).withColumn(
        "filter_date", F.coalesce("be_delivered_time", "be_delivery_failed_lost_time"))


#: The printed columns of both carriers, in the order of the sheet.
SHEET = (
    "order_id", "is_multi_parcel", "consignment", "order_sn", "shipping_traceno", "lm_tracking_number", "log_id",
    "fulfilment_shipping_carrier", "shop_id", "seller_id", "buyer_id", "be_bpsf", "be_esf", "be_asf", "sls_asf", "sls_esf",
    "seller_state", "seller_city", "seller_district", "buyer_state", "buyer_city", "buyer_district",
    "multi_arranged_time", "multi_delivered_time", "order_weight", "be_delivered_time", "be_delivery_failed_lost_time",
    "day_of_week_delivery", "day_of_week_return", "logistics_status", "added_leadtime", "ship_from", "ship_to",
    "sls_first_return_attempt", "sls_first_delivery_attempt", "total_sla", "is_dropoff", "sls_received_time",
    "fe_schedule_pickup", "sls_first_pickup_attempt", "sls_pickup_done", "adjusted_pickup", "sls_first_delivery_pending",
    "sls_delivery_done", "sls_return_time", "adjusted_return", "sls_return_pending", "sls_del_failed", "sla", "pickup",
    "inter", "intra", "delivery_w_weekend", "nb_delivery_holiday", "disaster", "return_w_weekend", "nb_return_holiday",
    "limit_leadtime_delivery", "del_leadtime", "total_leadtime_delivery", "del_leadtime_overall", "limit_leadtime_return",
    "return_leadtime", "total_leadtime_return", "return_leadtime_overall", "is_delay_pickup", "is_delay_delivery",
    "is_delay_delivery_overall", "is_delay_return", "is_delay_return_overall", "final_penalty")


def _printed(df: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    """The sheet's columns without repeated rows."""
    return df.withColumns({
        "shipping_traceno": F.col("lm_tracking_number"), "be_bpsf": F.col("buyer_paid_shipping_fee"),
        "be_esf": F.col("estimate_shipping_fee"), "disaster": F.lit(0)}).select(*SHEET, *extra).distinct()


def economy_sheet(df: DataFrame) -> DataFrame:
    """:func:`economy_penalty` as it is printed: with the regions; it has no pickup and district add-ons."""
    return _printed(df.withColumns({c: F.lit(0) for c in ("pickup", "inter", "intra")}), ("seller_region", "buyer_region"))


def express_sheet(df: DataFrame) -> DataFrame:
    """:func:`express_penalty` as it is printed: with the looked-up addresses and the day it is filtered by."""
    return _printed(df, ("concat_seller_address", "concat_buyer_address", "filter_date"))
